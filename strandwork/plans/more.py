"""Registered queries of sources, sinks, conditions, evaluation, sampling and verification, each beside its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import arrays, parsing, tables
from strandwork.functions import sequence as seq
from strandwork.operators import assays, conditions, evaluation, sampling, selection, similarity, verify
from strandwork.sources import fasta
from strandwork.sources import tables as files

from .queries import ACTIVITY, AGG, CHARGE, GRAM, META, SCORES, VALID, activity, n_of, query, rounded, runs, total, valid
from .views import view


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one on a local master."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='strandwork-')).rstrip('/')}/{uuid.uuid4().hex}"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Peptides numbered from 1 by pos."""
    rows = view(spark, d, "peptides").orderBy("pos").rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0]["pos"], x[0]["sequence"]))
    return rows.toDF("n long, pos long, sequence string")


_RANKED = "r AS (SELECT row_number() OVER (ORDER BY pos) AS n, pos, sequence FROM peptides)"


@query(f", {_RANKED} SELECT 'p_' || n AS header, sequence FROM r")
def fasta_round_trip(spark, d):
    folder = f"{scratch(spark)}.fasta"
    fasta.write(view(spark, d, "peptides"), folder, "p", "_")
    return fasta.headed(spark, folder).select("header", "sequence")


@query("SELECT sequence, count(*) AS n FROM peptides WHERE sequence<>'' GROUP BY sequence")
def fasta_positives(spark, d):
    folder = f"{scratch(spark)}.fa"
    fasta.write(view(spark, d, "peptides"), folder)
    return files.read_positives(spark, folder).groupBy("sequence").agg(F.count("*").alias("n"))


@query("SELECT CAST(pos AS VARCHAR) AS pos, NULLIF(sequence,'') AS sequence, printf('%.6f', length(sequence)/7e0) AS x FROM peptides")
def csv_round_trip(spark, d):
    folder = f"{scratch(spark)}.csv"
    files.write_csv(view(spark, d, "peptides").select("pos", "sequence", (F.length("sequence") / 7.0).alias("x")), folder, 6)
    return files.read_table(spark, folder)


@query(f", {VALID} SELECT sequence FROM v WHERE length(sequence) BETWEEN 10 AND 30")
def distinct_in_range(spark, d):
    return files.distinct_sequences(valid(spark, d).withColumn("role", F.lit("positive")), "positive", 10, 30)


@query("SELECT lang AS model, count(*) AS n, NULL::BIGINT AS longest FROM peptides GROUP BY lang UNION ALL SELECT source, NULL, max(length(sequence)) FROM peptides GROUP BY source")
def ledger_union(spark, d):
    p = view(spark, d, "peptides")
    old = p.groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("n"))
    return files.ledger(old, p.groupBy(F.col("source").alias("model")).agg(F.max(F.length("sequence")).cast("long").alias("longest")))


@query(f", {VALID} SELECT sequence, array_to_string(string_split(sequence,''),' ') AS spaced, round(2e0*least(length(sequence),20)/(length(sequence)+20),9) AS most FROM v")
def spaced_sequences(spark, d):
    s = F.col("sequence")
    return valid(spark, d).select(s, files.spaced(s).alias("spaced"), F.round(similarity.ratio_bound(F.length(s), F.lit(20)), 9).alias("most"))


_REQUESTS = """q AS (SELECT pos, CASE pos%4 WHEN 0 THEN NULL WHEN 1 THEN 'AMP ' WHEN 2 THEN '1' ELSE 'x' END AS is_amp, CASE pos%3 WHEN 0 THEN NULL WHEN 1 THEN 'Escherichia coli' ELSE 'candida albicans' END AS species,
 CASE pos%5 WHEN 0 THEN 'positive' WHEN 1 THEN '' END AS gram, CASE pos%2 WHEN 0 THEN 'measured' END AS hc50_source, CASE WHEN pos%7>0 THEN (pos%7)*3e0 END AS mic_um, pos%6=0 AS mic_censored, CASE WHEN pos%9>0 THEN 0.01e0*(pos%9) END AS hc50_um,
 CASE WHEN pos%8>0 THEN pos%8-4e0 END AS gram_selectivity, CASE WHEN pos%10>0 THEN CAST(CASE WHEN pos%12=0 THEN 0 ELSE 2*(pos%20)+9 END AS INT) END AS length, CASE WHEN pos%13=0 THEN 0.6e0 END AS charge_per_res, CASE WHEN pos%3>0 THEN pos%11-3e0 END AS net_charge, CASE WHEN pos%2=1 THEN 0.5e0 END AS mu_h,
 CASE WHEN pos%5>1 THEN pos%5-6e0 END AS gravy, CASE WHEN pos%4>1 THEN CAST(pos%4 AS INT) END AS cys_class FROM peptides)"""
_AXIS = "CASE WHEN {x}>0 THEN least(greatest((log10({x})+1)/4,0),1) END"
_CLIP = "CASE WHEN {x} IS NOT NULL THEN least(greatest({e},0),1) END"
_MASKED = f"""c AS (SELECT pos, CASE is_amp WHEN 'AMP ' THEN 2 WHEN '1' THEN 1 ELSE 0 END AS is_amp_idx, CASE species WHEN 'Escherichia coli' THEN 7 ELSE 0 END AS species_idx,
 CASE WHEN gram='positive' THEN 2 WHEN species='Escherichia coli' THEN 1 WHEN species='candida albicans' THEN 3 ELSE 0 END AS gram_idx, coalesce(cys_class,0) AS cys_class_idx, CASE WHEN mic_um IS NULL THEN 0 WHEN mic_censored THEN 2 ELSE 1 END AS mic_censored_idx, CASE hc50_source WHEN 'measured' THEN 1 ELSE 0 END AS hc50_source_idx,
 {_AXIS.format(x='mic_um')} AS log_mic, {_AXIS.format(x='hc50_um')} AS log_hc50, {_CLIP.format(x='gram_selectivity', e='gram_selectivity/6+0.5')} AS gram_selectivity, coalesce({_CLIP.format(x='length', e='(length-8)/42e0')},0.5) AS length_norm,
 coalesce(charge_per_res, CASE WHEN length<>0 AND net_charge IS NOT NULL THEN CASE WHEN length>0 THEN least(greatest((net_charge/length+1)/2,0),1) ELSE 0.5 END END) AS charge_per_res, mu_h, {_CLIP.format(x='gravy', e='(gravy+4.5)/9')} AS gravy FROM q)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_REQUESTS.removeprefix("q AS (").rstrip(")").replace("FROM peptides", "FROM {peptides}"), peptides=view(spark, d, "peptides"))


_AXES = ", ".join(f"round(coalesce({a},0),6) AS {a}, CASE WHEN {a} IS NULL THEN 0e0 ELSE 1e0 END AS {a}_mask" for a in conditions.CONTINUOUS)
_TOLD = " || ' ' || ".join([f"'{a}=' || {a}_idx" for a in conditions.CATEGORICAL] + [f"'{a}=' || CASE WHEN {a} IS NULL THEN 'unknown' ELSE printf('%.3f', {a}) END" for a in conditions.CONTINUOUS])


@query(f", {_REQUESTS}, {_MASKED} SELECT pos, {', '.join(f'{a}_idx' for a in conditions.CATEGORICAL)}, {_AXES} FROM c")
def request_conditions(spark, d):
    out = conditions.masked(conditions.built(requests(spark, d), {"escherichia coli": 7}))
    return rounded(out.select("pos", *[f"{a}_idx" for a in conditions.CATEGORICAL], *[x for a in conditions.CONTINUOUS for x in (a, f"{a}_mask")]))


@query(f", {_REQUESTS}, {_MASKED} SELECT pos, {_TOLD} AS told FROM c")
def condition_texts(spark, d):
    return conditions.masked(conditions.built(requests(spark, d), {"escherichia coli": 7})).select("pos", conditions.described().alias("told"))


@query(f", {_REQUESTS}, n AS (SELECT range+8 AS length, 100//43 + (range < 100%43)::INT AS count FROM range(43)) SELECT length::INT AS length, sum(count)::BIGINT AS n FROM n GROUP BY length")
def uniform_length_grid(spark, d):
    one = requests(spark, d).orderBy("pos").limit(1)  # one request, over all lengths
    return conditions.length_grid(one, sampling.uniform_lengths(spark, 100, 8, 50)).groupBy("length").agg(F.count("*").alias("n"))


@query(f", {VALID}, b AS (SELECT length(sequence) AS length, count(*) AS n FROM v GROUP BY 1), e AS (SELECT length, 500*n/(SELECT sum(n) FROM b)::DOUBLE AS x FROM b), f AS (SELECT *, row_number() OVER (ORDER BY round(x-floor(x),12) DESC, length) AS r, 500-sum(floor(x)) OVER () AS rest FROM e) SELECT length, (floor(x)+(r<=rest)::INT)::BIGINT AS count FROM f WHERE floor(x)+(r<=rest)::INT>0")
def empirical_length_counts(spark, d):
    return sampling.empirical_lengths(sampling.capped_reference(valid(spark, d).select(F.length("sequence").alias("length")), 50), 500)


@query("SELECT species, count(*) AS n FROM (SELECT species, unnest(range(0, 20*weight)) FROM (VALUES " + ",".join(f"('{s}',{w})" for s, w in tables.panel().items()) + ") p(species,weight)) GROUP BY species", ())
def conditioned_grid(spark, d):
    cells = selection.apportioned(selection.grid(spark).groupBy("species").agg((F.sum("weight")).alias("weight")).withColumn("idx", F.col("species")), 400)
    lengths = view(spark, d, "peptides").select("pos", F.length("sequence").alias("length"))
    return conditions.conditioned_grid(cells, lengths).groupBy("species").agg(F.count("*").alias("n"))


@query("SELECT steps, weight, round(e,6) AS mean_axis_error FROM (VALUES (16,1e0,0.9e0,0.2e0),(32,1e0,0.4e0,0.1e0),(32,2e0,0.6e0,0.2e0),(64,1e0,0.8e0,0.3e0)) t(steps,weight,uniqueness,e) WHERE uniqueness>=0.5 ORDER BY e, steps, weight LIMIT 1", ())
def best_setting(spark, d):
    sweep = spark.createDataFrame([(16, 1.0, 0.9, 0.2), (32, 1.0, 0.4, 0.1), (32, 2.0, 0.6, 0.2), (64, 1.0, 0.8, 0.3)], "steps int, weight double, uniqueness double, mean_axis_error double")
    return conditions.best_setting(sweep).select("steps", "weight", "mean_axis_error")


@query(f", {VALID} SELECT round(avg(abs((length(sequence)-8)/42e0-0.5)),6) AS error_length_norm, round(avg(abs(least(greatest(({CHARGE}/length(sequence)+1)/2,0),1)-0.6)),6) AS error_charge_per_res, NULL::DOUBLE AS error_mu_h, NULL::DOUBLE AS error_gravy, round((avg(abs((length(sequence)-8)/42e0-0.5))+avg(abs(least(greatest(({CHARGE}/length(sequence)+1)/2,0),1)-0.6)))/2,6) AS mean_axis_error FROM v")
def axis_errors(spark, d):
    return rounded(conditions.axis_errors(valid(spark, d).withColumns(parsing.features(F.col("sequence"))), {"length_norm": 0.5, "charge_per_res": 0.6}))


_META = f", {ACTIVITY}, {AGG}, {META}, g AS (SELECT sequence, species, CASE WHEN mic_um>0 THEN least(greatest((log10(mic_um)+1)/4,0),1) END AS log_mic FROM meta)"


def meta(spark: SparkSession, d: str) -> DataFrame:
    return assays.conditioning(assays.metadata(view(spark, d, "peptides"), activity(spark, d)))


@query(f"{_META} SELECT sequence, species, round(1e0/count(*) OVER (PARTITION BY CASE WHEN log_mic IS NULL THEN 'nomic' ELSE coalesce(species,'-') END),9) AS weight FROM g", ("assay_raw",))
def species_stratum_weights(spark, d):
    rows = meta(spark, d).select("sequence", "species", "log_mic", F.coalesce("species", F.lit("-")).alias("species_idx"))
    return rounded(evaluation.stratum_weights(rows).select("sequence", "species", "weight"), 9)


@query("SELECT pos, CASE lang WHEN 'en' THEN 3e0/(SELECT count(*) FROM peptides WHERE lang='en') WHEN 'fr' THEN 1e0/(SELECT count(*) FROM peptides WHERE lang='fr') ELSE 0e0 END AS weight FROM peptides")
def class_weights(spark, d):
    rows = view(spark, d, "peptides").withColumn("k", F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(0))
    return evaluation.class_weights(rows, "k", {1: 3.0, 2: 1.0}).select("pos", "weight")


@query(f"{_META} SELECT count(*) AS n, count(DISTINCT sequence) AS sequences, count(log_mic) AS with_mic, count(species) AS with_species, count(*) FILTER (species='escherichia coli') AS coli FROM g", ("assay_raw",))
def build_summary(spark, d):
    return meta(spark, d).agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("sequences"), F.count("log_mic").alias("with_mic"), F.count("species").alias("with_species"), F.count_if(F.col("species") == "escherichia coli").alias("coli"))


@query(f", {ACTIVITY}, w AS (SELECT sequence, {GRAM} AS gram, value_um FROM activity WHERE endpoint='mic' AND species IS NOT NULL), s AS (SELECT sequence, avg(log10(value_um)) FILTER (gram='positive') - avg(log10(value_um)) FILTER (gram='negative') AS x FROM w GROUP BY sequence) SELECT p.sequence, round(x,6) AS gram_selectivity_raw, round(CASE WHEN x IS NOT NULL THEN least(greatest(x/6+0.5,0),1) END,6) AS axis, round(CASE WHEN x IS NOT NULL THEN (least(greatest(x/6+0.5,0),1)-0.5)*6 END,6) AS back FROM (SELECT DISTINCT sequence FROM peptides WHERE sequence<>'') p LEFT JOIN s USING (sequence)", ("assay_raw",))
def metadata_selectivity(spark, d):
    own = view(spark, d, "peptides").filter("sequence <> ''").select("sequence").distinct()
    axis = parsing.selectivity_axis(F.col("gram_selectivity_raw"))
    return rounded(own.join(assays.selectivity(activity(spark, d)), "sequence", "left").select("sequence", "gram_selectivity_raw", axis.alias("axis"), parsing.from_selectivity_axis(axis).alias("back")))


_D = "d AS (SELECT b.x-a.x AS d FROM runs a JOIN runs b USING (seed) WHERE a.model='en' AND b.model='fr'), s AS (SELECT avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n FROM d)"


@query(f", runs AS (SELECT lang AS model, CAST(substr(source,4) AS INT)%3 AS seed, avg(length(sequence))::DOUBLE AS x FROM peptides GROUP BY ALL), {_D} SELECT round(m,6) AS delta, round(sd/sqrt(n),6) AS delta_se, round(m/(sd/sqrt(n)),6) AS t, round(1-abs(m/(sd/sqrt(n)))/sqrt(power(m/(sd/sqrt(n)),2)+2),6) AS p, round(m/sd,6) AS cohens_d, n FROM s")
def paired_test(spark, d):
    return rounded(evaluation.paired_test(runs(spark, d), "model", "en", "fr", "seed", "x"))


@query(f", q AS (SELECT DISTINCT sequence FROM peptides WHERE sequence<>''), f AS (SELECT sequence, {CHARGE} AS charge, {total('sequence', tables.EISENBERG)}/length(sequence) AS e, sequence IN (SELECT sequence FROM refset_plus) AS known FROM q) SELECT (SELECT count(*) FROM peptides) AS generated, count(*) AS \"unique\", round(100*avg((NOT known)::INT),6) AS novelty_pct, round(100*avg((length(sequence) BETWEEN 8 AND 50 AND {n_of('sequence', 'C')}<=2)::INT),6) AS compliant_pct, round(100*avg((round(charge,9) BETWEEN 2 AND 10 AND length(sequence) BETWEEN 10 AND 30 AND round(e,9) BETWEEN -0.5 AND 0.8)::INT),4) AS expert_range_pct, round(100*avg(({n_of('sequence', 'C')}=0)::INT),6) AS cys_free_pct, round(median(length(sequence)),6) AS median_length, round(median(charge),6) AS median_net_charge FROM f", ("peptides", "refset", "refset_plus"))
def set_metrics(spark, d):
    columns = ["generated", "unique", "novelty_pct", "compliant_pct", "expert_range_pct", "cys_free_pct", "median_length", "median_net_charge"]
    out = evaluation.set_metrics(view(spark, d, "peptides"), view(spark, d, "refset_plus"), identity=False, columns=columns)
    return rounded(out.withColumn("expert_range_pct", F.round("expert_range_pct", 4)))


@query("SELECT count(length(sequence)) AS n, round(median(length(sequence)),6) AS median, round(avg(length(sequence)),6) AS mean, round(100*avg((length(sequence)>40)::INT),6) AS above_pct FROM peptides")
def described_lengths(spark, d):
    return rounded(evaluation.described(view(spark, d, "peptides").withColumn("n", F.length("sequence")), "n", 40))


@query()
def score_bootstrap(spark, d):
    top = selection.panel_success(selection.predictions(valid(spark, d))).orderBy("mean_log_mic", "sequence").limit(100)
    return evaluation.bootstrap(top.select(F.col("mean_log_mic").alias("value")))


@query(f", {VALID}, {SCORES}, x AS (SELECT * FROM s2 ORDER BY score DESC, sequence LIMIT 100) SELECT count(*) AS n, round(avg(success_gram_negative),6) AS gram_negative, round(avg(success_gram_positive),6) AS gram_positive, round(power(10,min(mean_log_mic)),6) AS least_mic, round(power(10,max(mean_log_mic)),6) AS most_mic FROM x")
def selection_report(spark, d):
    top = selection.panel_success(selection.predictions(valid(spark, d))).orderBy(F.desc("score"), "sequence").limit(100).withColumn("identity", F.lit(0.0))
    return rounded(evaluation.selection_report(top).select("n", "gram_negative", "gram_positive", "least_mic", "most_mic"))


_RECORDS = f"{_RANKED}, f AS (SELECT n AS pos, CASE WHEN n%7=0 THEN ' ' ELSE 'h' || n END AS header, CASE WHEN n%5=0 THEN sequence || 'BX' ELSE sequence END AS sequence FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pos) AS k, 'Record ' || pos || ' (''' || header || '''): ' AS o FROM f)"


@query(f""", {_RECORDS}, m AS (SELECT pos, unnest([CASE WHEN trim(header)='' THEN 'Record ' || pos || ': missing header.' END, CASE WHEN sequence='' THEN o || 'empty sequence.' END, CASE WHEN sequence LIKE '%BX' THEN o || 'invalid characters [''B'', ''X''].' END,
 CASE WHEN length(sequence) BETWEEN 1 AND 7 THEN o || 'sequence too short (' || length(sequence) || ' < 8).' END, CASE WHEN length(sequence)>50 THEN o || 'sequence too long (' || length(sequence) || ' > 50).' END, CASE WHEN sequence<>'' AND k>1 THEN o || 'duplicate sequence.' END]) AS message FROM g)
 SELECT pos, message FROM m WHERE message IS NOT NULL UNION ALL SELECT 0, 'Expected 50000 sequences, got ' || count(*) || '.' FROM f HAVING count(*) NOT IN (0, 50000)""")
def file_findings(spark, d):
    n = F.col("n")
    rows = ranked(spark, d).select(n.alias("pos"), F.when(n % 7 == 0, " ").otherwise(F.concat(F.lit("h"), n.cast("string"))).alias("header"), F.when(n % 5 == 0, F.concat("sequence", F.lit("BX"))).otherwise(F.col("sequence")).alias("sequence"))
    return verify.file_findings(rows, 50_000)


@query(f", {VALID}, {SCORES}, o AS (SELECT sequence, row_number() OVER (ORDER BY score DESC, sequence) AS rank FROM s2), t AS (SELECT sequence, row_number() OVER (ORDER BY mean_log_mic, sequence) AS rank FROM s2 WHERE eligible), a AS (SELECT * FROM t WHERE rank<=100), b AS (SELECT * FROM o WHERE rank<=100) SELECT (SELECT count(*) FROM a FULL JOIN b USING (rank) WHERE a.sequence IS DISTINCT FROM b.sequence) AS differing, (SELECT min(rank) FROM a FULL JOIN b USING (rank) WHERE a.sequence IS DISTINCT FROM b.sequence)::INT AS first_mismatch, (SELECT count(*) FROM (SELECT sequence FROM a INTERSECT SELECT sequence FROM b)) AS shared, (SELECT count(*)>=100 FROM b) AS long_enough")
def prefix_findings(spark, d):
    from pyspark.sql import Window

    x = selection.panel_success(selection.predictions(valid(spark, d)))
    numbered = lambda df, *order: df.orderBy(*order).limit(100).select("sequence", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    return verify.prefix_findings(numbered(x.filter("eligible"), "mean_log_mic", "sequence"), sampling.prefix_of(numbered(x, F.desc("score"), "sequence"), 100), 100)


@query(", c AS (SELECT DISTINCT pos%37 AS cluster FROM peptides), r AS (SELECT cluster, row_number() OVER (ORDER BY md5('0|' || cluster), cluster) AS k, count(*) OVER () AS n FROM c) SELECT cluster, k<=round_even(0.2e0*n,0) AS held FROM r")
def cluster_holdout(spark, d):
    return sampling.holdout(view(spark, d, "peptides").select((F.col("pos") % 37).alias("cluster")))


@query(f", {VALID}, a AS (SELECT sequence, row_number() OVER (ORDER BY sequence) AS k FROM v), b AS (SELECT length(sequence) AS label, row_number() OVER (ORDER BY md5('0|' || sequence), sequence) AS k FROM v) SELECT sequence, label FROM a JOIN b USING (k)")
def permuted_labels(spark, d):
    return sampling.permuted(valid(spark, d).withColumn("label", F.length("sequence")), "sequence", "label")


@query()
def weighted_draws(spark, d):
    return sampling.weighted_sample(view(spark, d, "peptides").withColumn("w", F.length("sequence")), "pos", "w", 1000)


@query(f", {VALID}, s AS (SELECT sequence, length(sequence)%5 AS fold FROM v WHERE length(sequence)%11>0) SELECT v.sequence, coalesce(fold=0, false) AS validation FROM v LEFT JOIN s USING (sequence)")
def fold_membership(spark, d):
    n = F.length("sequence")
    v = valid(spark, d)
    return sampling.with_folds(v, v.filter(n % 11 > 0).withColumn("fold", n % 5)).select("sequence", "validation")


@query(f", {VALID}, c AS (SELECT min(sequence) AS representative, sequence AS member FROM v GROUP BY sequence) SELECT sequence, coalesce(substr(representative,1,3), sequence) AS cluster FROM v LEFT JOIN c ON member=sequence AND length(sequence)<50")
def cluster_fallback(spark, d):
    v = valid(spark, d)
    clusters = v.filter(F.length("sequence") < 50).select(F.substring("sequence", 1, 3).alias("representative"), F.col("sequence").alias("member"))
    return sampling.with_clusters(v, clusters).select("sequence", "cluster")


@query()
def deduplicated_references(spark, d):
    return sampling.deduplicated(view(spark, d, "refset").filter("length(sequence) >= 3").select(F.col("ref_id").alias("pos"), "sequence"))


@query()
def reference_clusters(spark, d):
    return sampling.clustered(view(spark, d, "refset").filter("length(sequence) >= 3"))


@query()
def indel_negatives(spark, d):
    v = valid(spark, d)
    made = v.select(sampling.indels(F.col("sequence")).alias("negative"), F.lit("indel").alias("kind")).union(selection.negatives(v).select("negative", "kind"))
    return made.repartition("negative").distinct().join(v.withColumnRenamed("sequence", "negative"), "negative", "left_anti")


@query("SELECT e.vec_id AS row, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)),4) AS total FROM embeddings e JOIN (SELECT DISTINCT pos//100000 AS row FROM peptides) p ON p.row=e.vec_id")
def embedding_lookup(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("x"))
    rows = view(spark, d, "peptides").select(F.expr("pos div 100000").alias("row")).distinct()
    return verify.looked_up(rows, e).select("row", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _reveal_sql(priority: str) -> str:
    return f"array_to_string(list_transform(list_sort(list_transform(list_filter(range(0,50), lambda i: i%3<>pos%3), lambda i: {{'p': {priority}, 'i': i}}))[1:(pos%9)::INT], lambda x: x.i), ',')"


_RING = "least(abs(i-pos%50), 50-abs(i-pos%50))"
_TURN = "least((((i*100-pos*10)%360)+360)%360, 360-(((i*100-pos*10)%360)+360)%360)"


@query(f"SELECT pos, {_reveal_sql(_RING)} AS span, {_reveal_sql(_TURN)} AS face, round_even((pos%101)/100e0*42+8,0)::INT AS target FROM peptides")
def reveal_orders(spark, d):
    pos = F.col("pos")
    masked = F.transform(arrays.positions(), lambda i: i % 3 != pos % 3)
    told = lambda priority: F.array_join(F.transform(arrays.reveal(masked, priority, (pos % 9).cast("int")), lambda i: i.cast("string")), ",")
    return view(spark, d, "peptides").select(pos, told(arrays.span_priority(pos % 50)).alias("span"), told(arrays.face_priority(pos * 10)).alias("face"), arrays.target_length((pos % 101) / 100.0).alias("target"))


@query()
def regressor_rows(spark, d):
    s = F.col("sequence")
    kind = F.element_at(F.array(*[F.lit(x) for x in tables.PANEL_NEGATIVE]), F.pmod(F.xxhash64(s), F.lit(6)).cast("int") + 1)
    row = arrays.feature_row([F.length(s), seq.net_charge(s)], kind, list(tables.PANEL_NEGATIVE)[:5], parsing.gram(kind), F.array(F.lit(0.5)))
    return valid(spark, d).select(s, row.alias("features"))


@query(f"{_META} SELECT species, count(*) AS n, round(count(*)/(SELECT count(*) FROM g WHERE species IS NOT NULL)::DOUBLE,9) AS share FROM g WHERE species IS NOT NULL GROUP BY species", ("assay_raw",))
def species_shares(spark, d):
    return rounded(evaluation.split_shares(meta(spark, d).filter("species is not null"), "species"), 9)


@query()
def stub_scores(spark, d):
    return evaluation.scored(valid(spark, d), lambda: lambda frame: frame["sequence"].str.len() / 50.0, ["sequence"])


@query("SELECT round(-ln(exp(2e0)/(exp(2e0)+exp(0e0)+exp(1e0)))/0.5e0,6) AS loss", ())
def masked_loss(spark, d):
    rows = spark.createDataFrame([([2.0, 0.0, 1.0], 0, True, 0.5), ([5.0, 0.0, 0.0], 1, False, 0.5)], "logits array<double>, target int, masked boolean, t double")
    return rounded(evaluation.diffusion_loss(rows))

