"""Registered queries of the peptide operators, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import arrays, parsing, tables
from strandwork.functions import sequence as seq
from strandwork.operators import assays, selection, similarity, stats, verify

from .views import duckdb, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AA = tables.AMINO_ACIDS


def query(sql: str | None = None, views: tuple[str, ...] = ("peptides",)):
    """Registers a function under its name; ``sql`` follows a WITH clause of the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{duckdb(*views)} {sql}" if views else sql
        return f

    return put


def valid(spark: SparkSession, d: str) -> DataFrame:
    """Distinct valid sequences, dealt again: adaptive execution would leave so few bytes to one task, with all that is computed on them."""
    # a number that a row has keeps the filter above the sequence, which else is made anew for each condition on it
    made = view(spark, d, "peptides").select("sequence", F.monotonically_increasing_id().alias("row"))
    found = made.filter(seq.is_valid(F.col("sequence")) & (F.col("row") >= 0)).select("sequence").distinct()
    return found.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# pieces of SQL
def of(c: str, values: dict[str, float]) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN '{a}' THEN {v}e0" for a, v in values.items()) + " ELSE 0e0 END)"


def chars(s: str) -> str:
    return f"string_split({s},'')"


def total(s: str, values: dict[str, float]) -> str:
    return f"list_sum(list_transform({chars(s)}, lambda c: {of('c', values)}))"


def n_of(s: str, letters: str) -> str:
    return f"(length({s})-length(translate({s},'{letters}','')))"


OK = f"length(sequence) BETWEEN 8 AND 50 AND regexp_full_match(sequence,'[{AA}]+')"
VALID = f"v AS (SELECT DISTINCT sequence FROM peptides WHERE {OK})"
CHARGE = f"({n_of('sequence', 'KR')}+0.1e0*{n_of('sequence', 'H')}-{n_of('sequence', 'DE')})"
SPECIES = tables.panel()
MIC = "round(-1e0 + 3e0*CAST(('0x'||substr(md5(concat(sequence,'|',species)),1,6)) AS INT)/16777216e0, 6)"
PANEL = "panel(species,weight,negative) AS (VALUES " + ",".join(f"('{s}',{w},{str(s in tables.PANEL_NEGATIVE).lower()})" for s, w in SPECIES.items()) + ")"
SCORES = f"""{PANEL}, pr AS (SELECT sequence, species, weight, negative, {MIC} AS log_mic FROM v CROSS JOIN panel),
 sc AS (SELECT sequence, sum(CASE WHEN log_mic<=log10(16) THEN weight ELSE 0 END)/20e0 AS success_overall,
  sum(CASE WHEN negative AND log_mic<=log10(16) THEN weight ELSE 0 END)/15e0 AS success_gram_negative,
  sum(CASE WHEN NOT negative AND log_mic<=log10(16) THEN weight ELSE 0 END)/5e0 AS success_gram_positive, round(sum(log_mic*weight)/20e0,9) AS mean_log_mic FROM pr GROUP BY sequence),
 s2 AS (SELECT *, success_gram_negative>0 AND success_gram_positive>0 AS eligible, -mean_log_mic - CASE WHEN success_gram_negative>0 AND success_gram_positive>0 THEN 0 ELSE 10 END AS score FROM sc)"""


def species_sql(raw: str) -> str:
    words = f"list_filter(string_split_regex(regexp_replace(regexp_replace({raw},'\\(.*?\\)',' ','g'),'[^A-Za-z. ]',' ','g'),'\\s+'), lambda w: w<>'')"
    long = "CASE " + " ".join(f"WHEN g='{k.split()[0]}' AND e='{k.split()[1]}' THEN '{v}'" for k, v in tables.ABBREVIATED.items()) + " ELSE g END"
    inner = f"SELECT {words} AS w"
    parts = f"SELECT w, trim(lower(w[1]),'.') AS g, CASE trim(lower(w[2]),'.') WHEN 'baumanii' THEN 'baumannii' ELSE trim(lower(w[2]),'.') END AS e FROM ({inner})"
    return f"(SELECT CASE WHEN w IS NULL OR len(w)=0 THEN NULL WHEN len(w)=1 OR e IN ('sp','spp','species') OR length(e)<2 THEN g ELSE concat({long},' ',e) END FROM ({parts}))"


GRAM = "CASE " + " ".join(f"WHEN string_split(species,' ')[1] IN ({','.join(repr(g) for g in names.split())}) THEN '{kind}'" for kind, names in tables.GRAM_GENERA.items()) + " ELSE 'unknown' END"
NUMBERS = r"list_filter(list_transform(regexp_extract_all(value,'[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), lambda x: x::DOUBLE), lambda x: x<>0)"
ACTIVITY = f"""sp AS (SELECT DISTINCT species AS raw FROM assay_raw), spn AS (SELECT raw, {species_sql('raw')} AS name FROM sp),
 num AS (SELECT *, {NUMBERS} AS x FROM assay_raw WHERE {OK}),
 val AS (SELECT *, CASE WHEN len(x)=1 THEN x[1] WHEN len(x)>1 AND x[1]>0 AND x[2]>0 THEN exp((ln(x[1])+ln(x[2]))/2) END AS y FROM num),
 activity AS (SELECT sequence, name AS species, CAST(NULL AS VARCHAR) AS strain, endpoint,
  CASE unit WHEN 'uM' THEN y WHEN 'nM' THEN y*0.001e0 ELSE y*1e0*1000e0/({total('sequence', tables.MASS)}+18.0153e0) END AS value_um, starts_with(value,'>') AS censored, source
  FROM val LEFT JOIN spn ON raw IS NOT DISTINCT FROM val.species WHERE y>0)"""
AGG = """fl AS (SELECT *, max(CASE WHEN endpoint='hc50' AND source='hemopi2_measured' THEN 1 ELSE 0 END) OVER (PARTITION BY sequence, species, endpoint) AS m FROM activity),
 agg AS (SELECT sequence, species, endpoint, coalesce(exp(avg(ln(value_um)) FILTER (NOT censored)), max(value_um)) AS value_um, count(*) FILTER (NOT censored)=0 AS censored, count(*)::INT AS n_measurements,
  array_to_string(list_sort(list_distinct(list(source))),',') AS sources, CASE WHEN endpoint='hc50' THEN CASE WHEN max(m)=1 THEN 'measured' WHEN max((source='hemopi2_predicted')::INT)=1 THEN 'predicted' END END AS hc50_source
  FROM fl WHERE m=0 OR source='hemopi2_measured' GROUP BY sequence, species, endpoint)"""
HC = "hc AS (SELECT sequence, exp(avg(ln(value_um))) AS hc50_um, CASE WHEN max((hc50_source='measured')::INT)=1 THEN 'measured' WHEN max((hc50_source='predicted')::INT)=1 THEN 'predicted' END AS hc50_source FROM agg WHERE endpoint='hc50' GROUP BY sequence)"
META = f"""{HC}, mic AS (SELECT sequence, species, value_um AS mic_um, censored AS mic_censored FROM agg WHERE endpoint='mic'),
 meta AS (SELECT p.sequence, species, mic_um, mic_censored, hc50_um, hc50_source FROM (SELECT DISTINCT sequence FROM peptides WHERE sequence<>'') p LEFT JOIN mic USING (sequence) LEFT JOIN hc USING (sequence))"""


def activity(spark: SparkSession, d: str) -> DataFrame:
    return assays.harmonized(view(spark, d, "assay_raw"))


@query(f"SELECT pos, upper(sequence) AS sequence, coalesce({OK}, false) AS valid, CASE WHEN length(sequence)<8 THEN 'too short' WHEN length(sequence)>50 THEN 'too long' END AS reason FROM peptides")
def clean_and_validate(spark, d):
    p = view(spark, d, "peptides").withColumn("sequence", seq.clean(F.col("sequence")))
    return p.select("pos", "sequence", seq.is_valid(F.col("sequence")).alias("valid"), seq.invalid_reason(F.col("sequence")).alias("reason"))


@query(f", {VALID} SELECT sequence, round({total('sequence', tables.MASS)}+18.0153e0,9) AS mass, round({CHARGE},9) AS charge, round({total('sequence', tables.HYDROPATHY)}/length(sequence),9) AS gravy, round({total('sequence', tables.EISENBERG)}/length(sequence),9) AS eisenberg, CASE WHEN {n_of('sequence', 'C')}=0 THEN 1 WHEN {n_of('sequence', 'C')}<=2 THEN 2 ELSE 3 END AS cys_class FROM v")
def sequence_scales(spark, d):
    s = F.col("sequence")
    return rounded(valid(spark, d).select(s, seq.mass(s).alias("mass"), seq.net_charge(s).alias("charge"), seq.mean(s, tables.HYDROPATHY).alias("gravy"), seq.mean(s, tables.EISENBERG).alias("eisenberg"), seq.cysteine_class(s).alias("cys_class")), 9)


_H = f"list_transform({chars('sequence')}, lambda c: {of('c', tables.EISENBERG)})"
_PART = "list_sum(list_transform(range(0,w), lambda i: h[k+i+1]*{f}(i*radians(100e0))))"


@query(f", {VALID}, h AS (SELECT sequence, {_H} AS h, least(11,length(sequence)) AS w FROM v), m AS (SELECT sequence, w, h, unnest(range(0, length(sequence)-w+1)) AS k FROM h) SELECT sequence, round(max(sqrt(pow({_PART.format(f='cos')},2)+pow({_PART.format(f='sin')},2))/w),6) AS mu_h FROM m GROUP BY sequence")
def hydrophobic_moment(spark, d):
    return valid(spark, d).select("sequence", F.round(seq.hydrophobic_moment(F.col("sequence")), 6).alias("mu_h"))


_FH = "list_sum(list_transform(range(1,length(sequence)+1), lambda i: {v}*{f}(i*radians(100e0))))"


@query(f", {VALID} SELECT sequence, round(sqrt(pow({_FH.format(v=of('string_split(sequence,' + chr(39) * 2 + ')[i]', tables.FITNESS_H), f='cos')},2)+pow({_FH.format(v=of('string_split(sequence,' + chr(39) * 2 + ')[i]', tables.FITNESS_H), f='sin')},2))/list_sum(list_transform({chars('sequence')}, lambda c: exp({of('c', tables.FITNESS_HX)}))),6) AS fitness FROM v")
def fitness_score(spark, d):
    return valid(spark, d).select("sequence", F.round(seq.fitness(F.col("sequence")), 6).alias("fitness"))


@query(f", {VALID}, g AS (SELECT DISTINCT sequence, substr(sequence, i::INT, 3) AS kmer FROM (SELECT sequence, unnest(range(1, length(sequence)-1)) AS i FROM v)) SELECT kmer, count(*) AS sequences FROM g GROUP BY kmer")
def kmer_index(spark, d):
    return valid(spark, d).select(F.explode(seq.kmers(F.col("sequence"))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("sequences"))


@query(f", {VALID}, b AS (SELECT *, least((length(sequence)-8)//6,6) AS band FROM v) SELECT sequence, band::INT AS band, concat(band*6+8,'-',CASE WHEN band>=6 THEN 50 ELSE band*6+13 END) AS label, (band*8+floor(greatest(-2,least(12,{n_of('sequence', 'KR')}-{n_of('sequence', 'DE')}))/3e0))::INT AS cluster FROM b")
def bands_and_clusters(spark, d):
    s = F.col("sequence")
    band = seq.length_band(F.length(s))
    return valid(spark, d).select(s, band.alias("band"), seq.band_label(band).alias("label"), seq.structural_cluster(s).alias("cluster"))


@query(f", {VALID} SELECT sequence, array_to_string(list_concat(list_transform({chars('sequence')}, lambda c: instr('{AA}',c)-1), list_resize([]::BIGINT[], 50-length(sequence), 20)),',') AS tokens, sequence AS decoded FROM v")
def token_canvas(spark, d):
    x = valid(spark, d).withColumn("t", seq.tokens(F.col("sequence")))
    return x.select("sequence", F.array_join(F.transform("t", lambda i: i.cast("string")), ",").alias("tokens"), seq.decoded(F.col("t")).alias("decoded"))


@query(f", {VALID} SELECT length(sequence) AS length, round((length(sequence)-8)/42e0,9) AS length_norm, round(least(greatest(({CHARGE}/length(sequence)+1)/2,0),1),9) AS charge_per_res, round(least(greatest(({total('sequence', tables.HYDROPATHY)}/length(sequence)+4.5)/9,0),1),9) AS gravy, sequence FROM v")
def dense_features(spark, d):
    return rounded(valid(spark, d).withColumns(parsing.features(F.col("sequence"))).select("length", "length_norm", "charge_per_res", "gravy", "sequence"), 9)


@query(f", {ACTIVITY} SELECT sequence, species, endpoint, round(value_um,6) AS value_um, censored, source FROM activity", ("assay_raw",))
def harmonize_activity(spark, d):
    return rounded(activity(spark, d).drop("strain"))


@query(f", sp AS (SELECT DISTINCT species AS raw FROM assay_raw WHERE species IS NOT NULL), n AS (SELECT raw, {species_sql('raw')} AS species FROM sp) SELECT raw, species, {GRAM} AS gram FROM n", ("assay_raw",))
def species_names(spark, d):
    x = view(spark, d, "assay_raw").select(F.col("species").alias("raw")).filter("raw is not null").distinct().withColumn("species", parsing.species(F.col("raw")))
    return x.withColumn("gram", parsing.gram(F.col("species")))


@query(f", {ACTIVITY}, {AGG} SELECT sequence, species, endpoint, round(value_um,6) AS value_um, censored, n_measurements, sources, hc50_source FROM agg", ("assay_raw",))
def aggregate_activity(spark, d):
    return rounded(assays.aggregated(activity(spark, d)))


@query(f", {ACTIVITY}, {AGG}, {HC} SELECT sequence, round(hc50_um,6) AS hc50_um, hc50_source FROM hc", ("assay_raw",))
def hc50_rollup(spark, d):
    return rounded(assays.hc50_by_sequence(assays.aggregated(activity(spark, d))))


@query(f", {ACTIVITY}, {AGG}, {META} SELECT sequence, species, round(mic_um,6) AS mic_um, mic_censored, round(hc50_um,6) AS hc50_um, hc50_source FROM meta", ("assay_raw",))
def build_metadata(spark, d):
    return rounded(assays.metadata(view(spark, d, "peptides"), activity(spark, d)))


@query(f""", {ACTIVITY}, {AGG}, {META}, g AS (SELECT *, {GRAM} AS gram FROM meta) SELECT sequence, species, gram, CASE gram WHEN 'negative' THEN 1 WHEN 'positive' THEN 2 WHEN 'fungal' THEN 3 WHEN 'mycobacterial' THEN 4 ELSE 0 END AS gram_idx,
 round(CASE WHEN mic_um>0 THEN least(greatest((log10(mic_um)+1)/4,0),1) END,6) AS log_mic, round(CASE WHEN hc50_um>0 THEN least(greatest((log10(hc50_um)+1)/4,0),1) END,6) AS log_hc50,
 CASE WHEN mic_um IS NULL THEN 0 WHEN mic_censored THEN 2 ELSE 1 END AS mic_censored_idx, CASE WHEN hc50_um IS NULL THEN 0 WHEN hc50_source='measured' THEN 1 WHEN hc50_source='predicted' THEN 2 ELSE 0 END AS hc50_source_idx FROM g""", ("assay_raw",))
def conditioning_features(spark, d):
    out = assays.conditioning(assays.metadata(view(spark, d, "peptides"), activity(spark, d)))
    return rounded(out.select("sequence", "species", "gram", "gram_idx", "log_mic", "log_hc50", "mic_censored_idx", "hc50_source_idx"))


@query(f", {ACTIVITY}, g AS (SELECT sequence, value_um, {GRAM} AS gram FROM activity WHERE endpoint='mic' AND species IS NOT NULL), w AS (SELECT sequence, avg(log10(value_um)) FILTER (gram='positive') - avg(log10(value_um)) FILTER (gram='negative') AS x FROM g GROUP BY sequence) SELECT sequence, round(x,6) AS gram_selectivity_raw FROM w WHERE x IS NOT NULL", ("assay_raw",))
def gram_selectivity(spark, d):
    return rounded(assays.selectivity(activity(spark, d)))


@query(f", {ACTIVITY} SELECT sequence, species, round(avg(log10(value_um)),6) AS log_mic, count(*)::INT AS n_measurements, {GRAM} AS gram, length(sequence) AS length FROM activity WHERE endpoint='mic' AND species IS NOT NULL GROUP BY sequence, species", ("assay_raw",))
def mic_table(spark, d):
    return rounded(assays.mic_table(activity(spark, d)).select("sequence", "species", "log_mic", "n_measurements", "gram", "length"))


@query(f", {ACTIVITY}, {AGG}, {META} SELECT species, row_number() OVER (ORDER BY species)::INT AS idx FROM meta WHERE species IS NOT NULL GROUP BY species HAVING count(*)>=20", ("assay_raw",))
def species_vocabulary(spark, d):
    return assays.vocabulary(assays.metadata(view(spark, d, "peptides"), activity(spark, d)))


@query(f", {ACTIVITY} SELECT species, count(*) AS n FROM activity WHERE species IS NOT NULL GROUP BY species ORDER BY n DESC, species LIMIT 15", ("assay_raw",))
def top_species(spark, d):
    return assays.top_species(activity(spark, d))


@query(f", {ACTIVITY} SELECT endpoint, source, count(*) AS n FROM activity GROUP BY endpoint, source", ("assay_raw",))
def provenance_counts(spark, d):
    return activity(spark, d).groupBy("endpoint", "source").agg(F.count("*").alias("n"))


@query()
def nearest_reference(spark, d):
    return rounded(similarity.nearest(valid(spark, d), view(spark, d, "refset")))


@query()
def nearest_shortlisted(spark, d):
    return rounded(similarity.nearest_shortlisted(valid(spark, d), view(spark, d, "refset").filter("length(sequence) >= 3")))


@query(f", {VALID}, r AS (SELECT DISTINCT sequence AS ref FROM refset WHERE length(sequence)>=3), gv AS (SELECT DISTINCT sequence, substr(sequence,i::INT,3) AS g FROM (SELECT sequence, unnest(range(1,length(sequence)-1)) AS i FROM v)), gr AS (SELECT DISTINCT ref, substr(ref,i::INT,3) AS g FROM (SELECT ref, unnest(range(1,length(ref)-1)) AS i FROM r)), s AS (SELECT sequence, ref, count(*) AS n FROM gv JOIN gr USING (g) GROUP BY ALL), j AS (SELECT s.sequence, s.ref, n/((SELECT count(*) FROM gv WHERE gv.sequence=s.sequence)+(SELECT count(*) FROM gr WHERE gr.ref=s.ref)-n) AS jaccard FROM s) SELECT sequence, ref, round(jaccard,6) AS jaccard, rank FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY jaccard DESC, ref)::INT AS rank FROM j) WHERE rank<=400", ("peptides", "refset"))
def kmer_shortlist(spark, d):
    return similarity.shortlist_rows(valid(spark, d), view(spark, d, "refset").filter("length(sequence) >= 3"))


@query()
def sampled_diversity(spark, d):
    return rounded(similarity.diversity(valid(spark, d)))


@query(f", {VALID} SELECT sequence FROM v WHERE sequence NOT IN (SELECT sequence FROM refset_plus)", ("refset_plus", "peptides", "refset"))
def exact_exclusion(spark, d):
    return verify.missing_members(valid(spark, d), view(spark, d, "refset_plus"))


@query(f", {VALID} SELECT sequence FROM v INTERSECT SELECT sequence FROM refset_plus", ("refset_plus", "peptides", "refset"))
def overlap(spark, d):
    return valid(spark, d).intersect(view(spark, d, "refset_plus").select("sequence"))


@query(f", {VALID}, {SCORES} SELECT sequence, round(success_overall,9) AS success_overall, round(success_gram_negative,9) AS success_gram_negative, round(success_gram_positive,9) AS success_gram_positive, round(mean_log_mic,9) AS mean_log_mic, eligible, round(score,9) AS score FROM s2")
def panel_scores(spark, d):
    return rounded(selection.panel_success(selection.predictions(valid(spark, d))), 9)


@query(f", {VALID}, {SCORES} SELECT floor((round(score*1e8)+5000)/10000)/1e4 AS tier, count(*) AS n FROM s2 GROUP BY tier")
def score_tiers(spark, d):
    return selection.panel_success(selection.predictions(valid(spark, d))).groupBy((F.floor((F.round(F.col("score") * 1e8) + 5000) / 10000) / 1e4).alias("tier")).agg(F.count("*").alias("n"))


_CL = f"(least((length(sequence)-8)//6,6)*8+floor(greatest(-2,least(12,{n_of('sequence', 'KR')}-{n_of('sequence', 'DE')}))/3e0))::INT"


@query(f", {VALID}, {SCORES}, c AS (SELECT sequence, score, {_CL} AS cluster FROM s2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, sequence) AS r FROM c) SELECT sequence, round(score,6) AS score, cluster FROM k WHERE r<=4 OR cluster<0 ORDER BY k.score DESC, sequence LIMIT 100")
def select_top(spark, d):
    x = selection.panel_success(selection.predictions(valid(spark, d))).select("sequence", "score", seq.structural_cluster(F.col("sequence")).alias("cluster"))
    return rounded(selection.capped_top(x, 100))


@query()
def select_diverse(spark, d):
    v = valid(spark, d)
    x = selection.panel_success(selection.predictions(v)).join(similarity.nearest(v, view(spark, d, "refset")), "sequence")
    return spark.createDataFrame(selection.diverse_top(x, 100, 100), "rank int, sequence string, score double, rung double")


@query(f"""SELECT species, weight, mic_um, hc50_um, selectivity, charge_per_res, mu_h, gravy, cys_class FROM (SELECT p.species, p.w*s.sw AS weight, mic_um, hc50_um, selectivity, charge_per_res, mu_h, gravy, 1 AS cys_class FROM (VALUES {",".join(f"('{s}',{w})" for s, w in SPECIES.items())}) p(species,w),
 (VALUES (2e0),(4e0),(8e0)) a(mic_um), (VALUES (128e0),(256e0)) b(hc50_um), (VALUES (-0.5e0,25),(0e0,40),(0.5e0,35)) s(selectivity,sw), (VALUES (0.5e0),(0.59e0),(0.68e0)) e(charge_per_res), (VALUES (0.3e0),(0.55e0),(0.8e0)) f(mu_h), (VALUES (-1.2e0),(-0.2e0),(0.8e0)) g(gravy))""")
def conditioning_grid(spark, d):
    return selection.grid(spark)


@query(f", {VALID}, b AS (SELECT least((length(sequence)-8)//6,6)::INT AS idx, count(*) AS weight FROM v GROUP BY 1), e AS (SELECT idx, weight, 500*weight/(SELECT sum(weight) FROM b)::DOUBLE AS x FROM b), f AS (SELECT *, row_number() OVER (ORDER BY round(x-floor(x),12) DESC, idx) AS r, 500-sum(floor(x)) OVER () AS rest FROM e) SELECT idx, weight, (floor(x)+(r<=rest)::INT)::BIGINT AS count FROM f")
def apportion_bands(spark, d):
    b = valid(spark, d).groupBy(seq.length_band(F.length("sequence")).alias("idx")).agg(F.count("*").alias("weight"))
    return selection.apportioned(b, 500)


@query("SELECT sequence, pos, lang FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pos) AS r FROM peptides) WHERE r=1")
def first_occurrences(spark, d):
    return selection.first_occurrences(view(spark, d, "peptides"), "sequence", "pos").select("sequence", "pos", "lang")


@query("SELECT pos, sequence FROM peptides ORDER BY md5(concat('7|',pos)), pos LIMIT 100")
def hash_sample(spark, d):
    return selection.hash_sample(view(spark, d, "peptides").select("pos", "sequence"), "pos", 100, "7")


@query(f", u AS (SELECT lang, source, upper(trim(sequence)) AS s FROM peptides), f AS (SELECT *, regexp_full_match(s,'[{AA}]+') AS a, length(s) BETWEEN 8 AND 50 AS l FROM u) SELECT lang, count(*) AS raw, count(*) FILTER (a) AS after_alphabet, count(*) FILTER (a AND l) AS after_length, count(DISTINCT s) FILTER (a AND l) AS after_dedup FROM f GROUP BY lang")
def attrition_funnel(spark, d):
    return stats.attrition(view(spark, d, "peptides"), ["lang"])


_FREQ = "SELECT a AS residue, coalesce(n,0)/(SELECT sum(n) FROM {c})::DOUBLE AS share FROM (SELECT unnest(string_split('" + AA + "','')) AS a) LEFT JOIN {c} ON a=c"
_CNT = "(SELECT c, count(*) AS n FROM (SELECT unnest(string_split(sequence,'')) AS c FROM {t}) WHERE c<>'' GROUP BY c)"


@query(f", {VALID}, c1 AS {_CNT.format(t='v')} SELECT residue, round(share,6) AS share FROM ({_FREQ.format(c='c1')})")
def residue_frequencies(spark, d):
    return rounded(stats.residue_shares(valid(spark, d)))


@query(f", {VALID}, c1 AS {_CNT.format(t='v')}, c2 AS {_CNT.format(t='refset')}, x AS (SELECT a.residue, greatest(a.share,1e-12) AS p, greatest(b.share,1e-12) AS q FROM ({_FREQ.format(c='c1')}) a JOIN ({_FREQ.format(c='c2')}) b USING (residue)) SELECT round(sum(p*log2(p/((p+q)/2))+q*log2(q/((p+q)/2)))/2,6) AS jsd FROM x", ("peptides", "refset"))
def jensen_shannon(spark, d):
    return rounded(stats.jensen_shannon(valid(spark, d), view(spark, d, "refset")))


@query(f", {VALID}, u AS (SELECT length(sequence) AS x, 1 AS a, 0 AS b FROM v UNION ALL SELECT length(sequence), 0, 1 FROM refset), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY x), w AS (SELECT abs(sum(a) OVER (ORDER BY x)/(sum(a) OVER ())::DOUBLE - sum(b) OVER (ORDER BY x)/(sum(b) OVER ())::DOUBLE) AS gap FROM g) SELECT round(max(gap),6) AS ks FROM w", ("peptides", "refset"))
def length_ks(spark, d):
    n = lambda df: df.select(F.length("sequence").alias("n"))
    return rounded(stats.kolmogorov_smirnov(n(valid(spark, d)), n(view(spark, d, "refset")), "n"))


@query(f", q AS (SELECT sequence, {CHARGE} AS charge, {total('sequence', tables.EISENBERG)}/length(sequence) AS e, sequence IN (SELECT sequence FROM refset_plus) AS known FROM peptides WHERE sequence<>'') SELECT count(*) AS n, round(count(DISTINCT sequence)/count(*)::DOUBLE,6) AS uniqueness, round(avg((NOT known)::INT),6) AS novelty, round(avg((length(sequence) BETWEEN 8 AND 50 AND {n_of('sequence', 'C')}<=2)::INT),6) AS compliant, round(avg((charge BETWEEN 2 AND 10 AND length(sequence) BETWEEN 10 AND 30 AND e BETWEEN -0.5 AND 0.8)::INT),6) AS expert_range, round(avg(({n_of('sequence', 'C')}=0)::INT),6) AS cysteine_free, round(median(length(sequence)),6) AS median_length, round(median(charge),6) AS median_charge, round(median(e),6) AS median_eisenberg FROM q", ("peptides", "refset", "refset_plus"))
def library_metrics(spark, d):
    return rounded(stats.library_metrics(view(spark, d, "peptides").filter("sequence <> ''"), view(spark, d, "refset_plus")))


_RUNS = "runs AS (SELECT lang AS model, CAST(substr(source,4) AS INT)%3 AS seed, avg(length(sequence))::DOUBLE AS x FROM peptides GROUP BY ALL)"


def runs(spark, d):
    p = view(spark, d, "peptides")
    return p.groupBy(F.col("lang").alias("model"), (F.substring("source", 4, 9).cast("int") % 3).alias("seed")).agg(F.avg(F.length("sequence")).alias("x"))


@query(f", {_RUNS} SELECT model, round(avg(x),6) AS mean, round(coalesce(stddev_samp(x)/sqrt(count(x)),0),6) AS se, count(x) AS n FROM runs GROUP BY model")
def seed_summary(spark, d):
    return rounded(stats.seed_summary(runs(spark, d), "model", "x"))


@query(f", {_RUNS}, df AS (SELECT a.x-b.x AS d FROM runs a JOIN runs b USING (seed) WHERE a.model='en' AND b.model='fr') SELECT round(avg(d),6) AS delta, round(stddev_samp(d)/sqrt(count(*)),6) AS se, round(avg(d)/(stddev_samp(d)/sqrt(count(*))),6) AS t, round(avg(d)/stddev_samp(d),6) AS d, count(*) AS n FROM df")
def paired_delta(spark, d):
    return rounded(stats.paired(runs(spark, d), "model", "en", "fr", "seed", "x"))


_MICS = f"m AS (SELECT sequence, species, avg(log10(value_um)) AS y FROM activity WHERE endpoint='mic' AND species IS NOT NULL GROUP BY ALL), t AS (SELECT *, {MIC} AS p FROM m)"


@query(f", {ACTIVITY}, {_MICS}, r AS (SELECT *, rank() OVER (PARTITION BY species ORDER BY y)+(count(*) OVER (PARTITION BY species, y)-1)/2e0 AS rx, rank() OVER (PARTITION BY species ORDER BY p)+(count(*) OVER (PARTITION BY species, p)-1)/2e0 AS ry FROM t) SELECT species, round(corr(rx,ry),4) AS spearman, round(corr(y,p),4) AS pearson, round(avg(abs(y-p)),4) AS mae, count(*) AS n FROM r GROUP BY species HAVING count(*)>=30", ("assay_raw",))
def oracle_agreement(spark, d):
    x = assays.mic_table(activity(spark, d)).select("sequence", "species", F.round("log_mic", 12).alias("y"))
    out = stats.agreement(x.withColumn("p", selection.stub_log_mic(F.col("sequence"), F.col("species"))), "y", "p", "species")
    return rounded(out.filter("n >= 30"), 4)


SQL["oracle_agreement"] = SQL["oracle_agreement"].replace("avg(log10(value_um)) AS y", "round(avg(log10(value_um)),12) AS y")


@query(f", {VALID}, b AS (SELECT least((length(sequence)-8)//6,6)::INT AS band, count(*) AS n FROM v GROUP BY 1) SELECT i::INT AS band, coalesce(n,0) AS n FROM range(0,7) t(i) LEFT JOIN b ON band=i")
def band_histogram(spark, d):
    b = valid(spark, d).groupBy(seq.length_band(F.length("sequence")).alias("band")).agg(F.count("*").alias("n"))
    return spark.range(7).select(F.col("id").cast("int").alias("band")).join(b, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'duplicate' AS problem, sum(c-1)::BIGINT AS n FROM (SELECT count(*) AS c FROM peptides GROUP BY sequence HAVING count(*)>1) HAVING sum(c-1)>0 UNION ALL SELECT 'too short', count(*) FROM peptides WHERE length(sequence)<8 HAVING count(*)>0 UNION ALL SELECT 'too long', count(*) FROM peptides WHERE length(sequence)>50 HAVING count(*)>0 UNION ALL SELECT 'in excluded set', count(DISTINCT sequence) FROM peptides WHERE sequence IN (SELECT sequence FROM refset_plus) HAVING count(*)>0", ("peptides", "refset", "refset_plus"))
def library_problems(spark, d):
    return verify.problems(view(spark, d, "peptides"), view(spark, d, "refset_plus"))


@query("SELECT pos, unnest(list_filter([CASE WHEN length(sequence)=0 THEN 'empty' END, CASE WHEN length(sequence) BETWEEN 1 AND 7 THEN 'too short' END, CASE WHEN length(sequence)>50 THEN 'too long' END, CASE WHEN r>1 THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS message FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pos) AS r FROM peptides)")
def record_messages(spark, d):
    return verify.record_messages(view(spark, d, "peptides"))


@query("SELECT sequence, pos, 1e0/count(*) OVER (PARTITION BY lang) AS w FROM peptides")
def stratum_weights(spark, d):
    from pyspark.sql import Window

    return view(spark, d, "peptides").select("sequence", "pos", (1.0 / F.count("*").over(Window.partitionBy("lang"))).alias("w"))


@query(", s AS (SELECT pos%37 AS c, count(*) AS n FROM peptides GROUP BY 1) SELECT count(*) AS clusters, count(*) FILTER (n=1) AS singletons, max(n) AS largest, round(sum(n)/count(*)::DOUBLE,6) AS redundancy FROM s")
def cluster_stats(spark, d):
    return rounded(stats.cluster_stats(view(spark, d, "peptides").withColumn("c", F.col("pos") % 37), "c"))


@query()
def cluster_splits(spark, d):
    sizes = view(spark, d, "peptides").groupBy((F.col("pos") % 37).alias("c")).agg(F.count("*").alias("n")).collect()
    out = selection.packed_splits([(r["c"], r["n"]) for r in sizes], {"train": 0.8, "val": 0.1, "test": 0.1})
    return spark.createDataFrame(sorted(out.items()), "cluster long, split string")


@query()
def synthetic_negatives(spark, d):
    return selection.negatives(valid(spark, d))


_M = "list_transform(range(0,50), lambda i: (((i*100%360)-(pos*10%360)+360)%360)<180)"


@query(f"SELECT pos, list_sum(list_transform({_M}, lambda x: x::INT))::INT AS face_masked, list_sum(list_transform(range(0,50), lambda i: (i>=pos%40 AND i<pos%40+greatest(0.3*50,1))::INT))::INT AS span_masked FROM peptides")
def mask_patterns(spark, d):
    n = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b.cast("int"))
    return view(spark, d, "peptides").select("pos", n(arrays.face_mask(F.pmod(F.col("pos") * 10, F.lit(360)), F.lit(0.5))).alias("face_masked"), n(arrays.span_mask(F.col("pos") % 40, F.lit(0.3))).alias("span_masked"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE + 2e0*(x::DOUBLE/2 - x::DOUBLE))),4) AS guided, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)),4) AS pooled FROM embeddings", ())
def guidance_and_pooling(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("u", F.col("embedding").cast("array<double>"))
    guided = arrays.guided(F.col("u"), F.transform("u", lambda x: x / 2), 2.0)
    return e.select("vec_id", F.round(F.aggregate(guided, F.lit(0.0), lambda a, x: a + x), 4).alias("guided"), F.round(arrays.masked_mean(F.col("u"), F.transform("u", lambda x: F.lit(1.0))), 4).alias("pooled"))


@query()
def library_screen(spark, d):
    """Flagship: valid peptides that no reference resembles, ranked by their score over the panel."""
    v = valid(spark, d)
    near = similarity.nearest(v, view(spark, d, "refset"))
    novel = near.filter("identity < 0.75").select("sequence", "identity")
    scores = selection.panel_success(selection.predictions(v)).select("sequence", "score", "eligible")
    return rounded(scores.join(novel, "sequence").orderBy(F.desc("score"), "sequence").limit(100).select("sequence", "score", "eligible", "identity"))
