"""Peptide, reference and assay tables made from the driver's tables, as SQL that Spark and DuckDB both run.

``{strip}`` removes what is no residue: Spark's regexp_replace replaces all matches, DuckDB's with 'g'.
``{clauses:x}`` is a table with a row for each clause of each whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STRIP = {"spark": "regexp_replace(upper(replace(part,'ß','')),'[^ACDEFGHIKLMNPQRSTVWY]','')", "duckdb": "regexp_replace(upper(replace(part,'ß','')),'[^ACDEFGHIKLMNPQRSTVWY]','','g')"}
#: Every clause of every text, numbered from 0; each is a sequence, too short or too long as it may be.
_CLAUSES = {
    "spark": "(SELECT *, posexplode(split(text, '[.,\\\\n]')) AS (clause, part) FROM {table})",
    "duckdb": "(SELECT *, unnest(range(0, len(parts))) AS clause, unnest(parts) AS part FROM (SELECT *, string_split_regex(text, '[.,\\n]') AS parts FROM {table}))",
}
CLAUSES = 100_000

PEPTIDES = f"SELECT doc_id * {CLAUSES} + clause AS pos, lang, source, {{strip}} AS sequence FROM {{clauses:documents}} t"
REFSET = f"SELECT item_id * {CLAUSES} + clause AS ref_id, {{strip}} AS sequence FROM {{clauses:benchmark}} t"
#: The references and the sequences that two sources or more have.
REFSET_PLUS = "SELECT sequence FROM refset UNION SELECT sequence FROM peptides GROUP BY sequence HAVING count(DISTINCT source) > 1"
ASSAY = f"""SELECT l.l_orderkey * 10 + l.l_linenumber AS row_id, p.sequence,
  CASE l.l_linenumber % 5 WHEN 0 THEN concat('>',q) WHEN 1 THEN q WHEN 2 THEN concat(q,' - ',q2) WHEN 3 THEN concat(q,'-',q2) ELSE concat('<',q) END AS value,
  CASE l_returnflag WHEN 'A' THEN 'µg/ml' WHEN 'R' THEN 'uM' ELSE 'nM' END AS unit,
  CASE WHEN l_linestatus='F' THEN NULL ELSE CASE l_suppkey % 10 WHEN 0 THEN 'E. coli' WHEN 1 THEN 'Escherichia coli ATCC 25922'
      WHEN 2 THEN 'S. aureus' WHEN 3 THEN 'A. baumanii' WHEN 4 THEN 'Pseudomonas aeruginosa (PAO1)' WHEN 5 THEN 'K. pneumoniae'
      WHEN 6 THEN 'C. albicans' WHEN 7 THEN 'Bacillus sp.' WHEN 8 THEN 'B. subtilis' ELSE NULL END END AS species,
  CASE WHEN l_linestatus='O' THEN 'mic' ELSE 'hc50' END AS endpoint,
  CASE WHEN l_linestatus='O' THEN 'grampa' WHEN l_suppkey % 4 = 0 THEN 'hemopi2_measured' ELSE 'hemopi2_predicted' END AS source
FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) AS q, CAST(CAST(2*l_quantity AS INT) AS VARCHAR(10)) AS q2
      FROM lineitem) l JOIN peptides p ON p.pos = l.l_partkey * {CLAUSES} + l.l_linenumber"""

VIEWS = {"peptides": (PEPTIDES, ["documents"]), "refset": (REFSET, ["benchmark"]), "refset_plus": (REFSET_PLUS, []), "assay_raw": (ASSAY, ["lineitem"])}
NEEDS = {"peptides": [], "refset": [], "refset_plus": ["refset", "peptides"], "assay_raw": ["peptides"]}


def _told(sql: str, engine: str) -> str:
    for table in ("documents", "benchmark"):
        sql = sql.replace(f"{{clauses:{table}}}", _CLAUSES[engine].replace("{table}", table))
    return sql.replace("{strip}", _STRIP[engine])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    sql = _told(sql, "spark")
    given = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in tables} | {x: view(spark, sf_dir, x) for x in NEEDS[name]}
    for x in given:  # names of arguments, not of tables
        sql = sql.replace(f"FROM {x}", f"FROM {{{x}}}").replace(f"JOIN {x}", f"JOIN {{{x}}}")
    return spark.sql(sql, **given)


def duckdb(*names: str) -> str:
    """A WITH clause that defines the views, for SQL that follows."""
    order = [x for x in VIEWS if x in names or any(x in NEEDS[n] or x in [y for m in NEEDS[n] for y in NEEDS[m]] for n in names)]
    return "WITH RECURSIVE " + ", ".join(f"{x} AS ({_told(VIEWS[x][0], 'duckdb')})" for x in order)
