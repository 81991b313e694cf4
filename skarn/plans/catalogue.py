"""The catalogue of queries over the star-schema and text tables, each with its SQL.

Stand-ins for source files keep the operators' algebra: an order is a function (its lines are
decisions, its quantity the lines of code), a nation a package, the order status a source set; an
order's consecutive suppliers are imports; events are audit runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import half_up, package_name
from skarn.operators import agreement, classify, clone_groups, clones, compare, erosion, graph, intervals, scoring
from skarn.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- erosion -------------------------------------------------------------------------------

_SETS = "CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'test' ELSE 'generated' END"
_MEASURES = f"""measures AS (
  SELECT {_SETS} AS source_set, n_name AS package_path, o_orderkey AS path, 1 + count(l_orderkey) AS cc,
         CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS sloc
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT *, cc * sqrt(sloc) AS mass, CAST(floor(cc * sqrt(sloc) * 1e6 + 0.5) AS BIGINT) AS micro, cc > 10 AS eroded FROM measures)"""
_TOTALS = """count(*) AS functions, CAST(sum(sloc) AS BIGINT) AS sloc, CAST(count(*) FILTER (eroded) AS BIGINT) AS eroded_count,
  floor(sum(micro) / 1e6 * 1000 + 0.5) / 1000 AS mass, floor(sum(CASE WHEN eroded THEN micro ELSE 0 END) / 1e6 * 1000 + 0.5) / 1000 AS eroded_mass,
  floor(sum(CASE WHEN eroded THEN micro ELSE 0 END) / nullif(sum(micro), 0) * 1e6 + 0.5) / 1e6 AS eroded_share"""


def measures(spark: SparkSession, d: str) -> DataFrame:
    per_order = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    packages = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("package_path"))
    kind = F.when(F.col("o_orderstatus") == "F", "production").when(F.col("o_orderstatus") == "O", "test").otherwise("generated")
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", kind.alias("source_set"))
    return orders.join(packages, "o_custkey").join(per_order, "o_orderkey", "left").select("source_set", "package_path", F.col("o_orderkey").alias("path"), (F.coalesce("n", F.lit(0)) + 1).alias("cc"), F.coalesce("q", F.lit(0.0)).cast("bigint").alias("sloc"))


@query(f"""WITH {_MEASURES} SELECT source_set, package_path, path, cc, sloc, floor(mass * 1000 + 0.5) / 1000 AS mass,
  row_number() OVER (PARTITION BY source_set ORDER BY mass DESC, path) AS rank FROM m WHERE eroded""")
def erosion_hotspots(spark, d):
    return erosion.hotspots(measures(spark, d))


@query(f"""WITH {_MEASURES}, p AS (SELECT DISTINCT s AS source_set, n_name AS package_path FROM nation, (VALUES ('production'), ('test'), ('generated'), ('vendored')) v(s))
SELECT source_set, package_path, coalesce(functions, 0) AS functions, coalesce(sloc, 0) AS sloc, coalesce(eroded_count, 0) AS eroded_count, coalesce(mass, 0) AS mass, coalesce(eroded_mass, 0) AS eroded_mass, eroded_share
FROM p LEFT JOIN (SELECT source_set, package_path, {_TOTALS} FROM m GROUP BY ALL) USING (source_set, package_path)""")
def erosion_by_package(spark, d):
    sets = F.explode(F.array(*map(F.lit, ("production", "test", "generated", "vendored"))))
    return erosion.by_package(measures(spark, d), t(spark, d, "nation").select(F.col("n_name").alias("package_path"), sets.alias("source_set")))


@query(f"WITH {_MEASURES} SELECT source_set, package_path, {_TOTALS}, CAST(grouping(source_set, package_path) AS BIGINT) AS level FROM m GROUP BY ROLLUP (source_set, package_path)")
def erosion_rollup(spark, d):
    return erosion.rolled_up(measures(spark, d))


@query(f"WITH {_MEASURES} SELECT source_set, quantile_disc(cc, 0.5) AS p50, quantile_disc(cc, 0.9) AS p90, max(cc) AS max FROM m GROUP BY source_set")
def cc_distribution(spark, d):
    return erosion.distribution(measures(spark, d))


@query(f"WITH {_MEASURES} SELECT cc, count(*) AS functions FROM m GROUP BY cc")
def cc_histogram(spark, d):
    return erosion.histogram(measures(spark, d))


_STATES = """s AS (SELECT source_set, count(*) AS functions, sum(micro) AS mass, sum(CASE WHEN eroded THEN micro ELSE 0 END) AS eroded, count(*) FILTER (eroded) AS n, max(cc) AS top FROM m GROUP BY source_set)"""


def native_metrics(spark, d) -> DataFrame:
    """id, state, value, reason of a catalogue of metrics; vendored has no functions, so its share is
    not applicable."""
    sums = erosion.with_mass(measures(spark, d)).groupBy("source_set").agg(F.sum(F.floor(F.col("mass") * 1e6 + 0.5).cast("bigint")).alias("mass"), F.sum(F.when(F.col("eroded"), F.floor(F.col("mass") * 1e6 + 0.5).cast("bigint")).otherwise(0)).alias("eroded"), F.count_if("eroded").alias("n"))
    sets = spark.createDataFrame([("production",), ("test",), ("generated",), ("vendored",)], "source_set string")
    full = F.broadcast(sets).join(sums, "source_set", "left")
    value = half_up(F.col("eroded") / F.col("mass"), 6)
    return full.select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("erosion.eroded-share."), "source_set").alias("id"), F.when(F.col("mass") > 0, "complete").otherwise("not-applicable").alias("state"), F.when(F.col("mass") > 0, value).alias("value"), F.when(F.coalesce("mass", F.lit(0)) == 0, "no functions").alias("reason")),
            F.struct(F.concat(F.lit("erosion.eroded-count."), "source_set").alias("id"), F.lit("complete").alias("state"), F.coalesce("n", F.lit(0)).cast("double").alias("value"), F.lit(None).cast("string").alias("reason")),
        )).alias("m")
    ).select("m.*")


_METRICS = f"""{_MEASURES}, {_STATES}, f AS (SELECT v.source_set, mass, eroded, n FROM (VALUES ('production'), ('test'), ('generated'), ('vendored')) v(source_set) LEFT JOIN s ON s.source_set = v.source_set),
metrics AS (SELECT 'erosion.eroded-share.' || source_set AS id, CASE WHEN mass > 0 THEN 'complete' ELSE 'not-applicable' END AS state, CASE WHEN mass > 0 THEN floor(eroded / mass * 1e6 + 0.5) / 1e6 END AS value, CASE WHEN coalesce(mass, 0) = 0 THEN 'no functions' END AS reason FROM f
UNION ALL SELECT 'erosion.eroded-count.' || source_set, 'complete', CAST(coalesce(n, 0) AS DOUBLE), NULL FROM f)"""


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def eroded_share_state(spark, d):
    return native_metrics(spark, d)


def scored_metrics(spark, d) -> DataFrame:
    """The native metrics with density and count of repeated lines, and one metric that is incomplete."""
    lines = repeated_lines(spark, d).agg(F.count("*").cast("double").alias("groups"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n"))
    everything = classify.lines(t(spark, d, "documents"), "doc_id", "text").agg(F.count("*").alias("total"))
    dup = lines.crossJoin(everything).select(F.explode(F.array(
        F.struct(F.lit("duplication.density.production").alias("id"), half_up(F.col("n") / F.col("total"), 6).alias("value")),
        F.struct(F.lit("duplication.groups.production").alias("id"), F.col("groups").alias("value")),
    )).alias("m")).select("m.id", F.lit("complete").alias("state"), "m.value")
    cycles = spark.createDataFrame([("import-cycle.density", "not-applicable", None), ("import-cycle.groups", "incomplete", 1.0)], "id string, state string, value double")
    return native_metrics(spark, d).select("id", "state", "value").unionByName(dup).unionByName(cycles)


_LINES = "lines AS (SELECT doc_id, i AS line, string_split(coalesce(text, ''), chr(10))[i] AS line_text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents))"
_REPEATED = "repeated AS (SELECT line_text, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM lines WHERE length(line_text) >= 20 GROUP BY line_text HAVING count(*) > 1)"
_FORMULA = ", ".join(f"('{a}', {b}, '{c}', {e}, '{f}', {g})" for a, b, c, e, f, g in scoring.FORMULA)


@query(f"""WITH {_METRICS}, {_LINES}, {_REPEATED}, all_m AS (SELECT id, state, value FROM metrics
UNION ALL SELECT 'duplication.density.production', 'complete', floor((SELECT sum(occurrences) FROM repeated) / (SELECT count(*) FROM lines) * 1e6 + 0.5) / 1e6
UNION ALL SELECT 'duplication.groups.production', 'complete', CAST((SELECT count(*) FROM repeated) AS DOUBLE)
UNION ALL SELECT 'import-cycle.density', 'not-applicable', NULL UNION ALL SELECT 'import-cycle.groups', 'incomplete', 1.0),
terms AS (SELECT f.*, state, CASE WHEN state = 'complete' THEN CASE WHEN kind = 'log' THEN 100 * ln(1 + value / k) / (1 + ln(1 + value / k)) ELSE least(greatest(value / k, 0), 1) * 100 END ELSE 0 END AS term, NOT coalesce(state IN ('complete', 'not-applicable'), false) AS bad
  FROM (VALUES {_FORMULA}) f(dimension, weight, id, share, kind, k) LEFT JOIN all_m a ON a.id = f.id),
dims AS (SELECT dimension, weight, bool_or(bad) AS degraded, floor(CASE WHEN bool_or(bad) THEN 100.0 ELSE sum(term * share) END * 1e6 + 0.5) / 1e6 AS score FROM terms GROUP BY ALL),
parts AS (SELECT *, floor(weight * score * 1e6 + 0.5) / 1e6 AS part FROM dims),
ind AS (SELECT *, CAST(least(greatest(floor(sum(part) OVER () + 0.5), 0), 100) AS BIGINT) AS index FROM parts),
ex AS (SELECT *, floor(coalesce(part * index / sum(part) OVER (), 0) * 1e9 + 0.5) / 1e9 AS e FROM ind)
SELECT dimension, score, CAST(floor(e) + CASE WHEN part > 0 AND row_number() OVER (ORDER BY floor((e - floor(e)) * 1e9 + 0.5) / 1e9 DESC, dimension) <= index - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS points, index, degraded, true AS partial FROM ex""")
def score_index(spark, d):
    return scoring.index(scored_metrics(spark, d))


@query("""WITH r AS (SELECT r_name, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name),
e AS (SELECT *, floor(CAST(cents AS DOUBLE) * 100 / CAST(sum(cents) OVER () AS DOUBLE) * 1e9 + 0.5) / 1e9 AS x FROM r)
SELECT r_name, cents, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY floor((x - floor(x)) * 1e9 + 0.5) / 1e9 DESC, r_name) <= 100 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS points FROM e""")
def apportion(spark, d):
    per = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cents = per.groupBy("r_name").agg(F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")).alias("cents"))
    return scoring.apportion(cents.withColumn("_total", F.lit(100)), "_total", "r_name", "cents").select("r_name", "cents", "points")


# --- classification and lines --------------------------------------------------------------

_PATH = "concat(source, '/', CASE WHEN doc_id % 7 = 0 THEN '__tests__/' WHEN doc_id % 11 = 0 THEN 'vendor/' WHEN doc_id % 13 = 0 THEN '__generated__/' ELSE 'src/' END, lang, '/f', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.test.ts' WHEN doc_id % 17 = 0 THEN '.d.ts' ELSE '.ts' END)"


def _case(values: list[str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{v}'" for (_, _, p), v in zip(classify.RULES, values, strict=True)) + f" ELSE '{default}' END"


_CLASSIFIED = f"files AS (SELECT doc_id, {_PATH} AS path FROM documents)"


def files(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"))


@query(f"WITH {_CLASSIFIED} SELECT doc_id, path, {_case([r[1] for r in classify.RULES], 'production')} AS source_set, {_case([r[0] for r in classify.RULES], 'default:production')} AS rule FROM files")
def classify_documents(spark, d):
    kind, rule = classify.source_set(F.col("path"))
    return files(spark, d).withColumns({"source_set": kind, "rule": rule})


@query(f"""WITH {_CLASSIFIED} SELECT doc_id, path, CASE WHEN regexp_matches(path, '^src1/(?:.*/)?f[^/]*\\.ts$') THEN 'test' WHEN regexp_matches(path, '^src[^/]/src/de/.*$') THEN 'generated' ELSE {_case([r[1] for r in classify.RULES], 'production')} END AS source_set,
CASE WHEN regexp_matches(path, '^src1/(?:.*/)?f[^/]*\\.ts$') THEN 'config:classify:src1/**/f*.ts' WHEN regexp_matches(path, '^src[^/]/src/de/.*$') THEN 'config:classify:src?/src/de/**' ELSE {_case([r[0] for r in classify.RULES], 'default:production')} END AS rule FROM files""")
def glob_override(spark, d):
    return classify.with_overrides(files(spark, d), [("src?/src/de/**", "generated"), ("src1/**/f*.ts", "test")])


_OWNERS = "owners AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files WHERE doc_id % 10 = 0 UNION SELECT DISTINCT split_part(path, '/', 1) FROM files WHERE doc_id % 3 = 0)"


@query(f"""WITH {_CLASSIFIED}, {_OWNERS} SELECT path, coalesce(max_by(directory, length(directory)), '.') AS owner FROM files LEFT JOIN owners ON starts_with(path, directory || '/') GROUP BY path""")
def owner_prefix(spark, d):
    f = files(spark, d)
    owners = f.where("doc_id % 10 = 0").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")).union(f.where("doc_id % 3 = 0").select(F.split_part("path", F.lit("/"), F.lit(1))))
    return classify.nearest_owner(f.select("path"), owners)


@query("SELECT DISTINCT source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e JOIN labels l ON l.doc_id = e.doc_id AND l.toxic = 1 WHERE e.source = d.source AND e.lang = 'es')")
def unsupported_packages(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    used = docs.where("lang = 'es'").join(t(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("source")
    return docs.select("source").distinct().join(used, "source", "left_anti")


_KIND = "CASE WHEN trim(line_text, ' ') = '' THEN 'blank' WHEN regexp_matches(line_text, '^\\s*(//|#|\\*|/\\*)') THEN 'commentOnly' ELSE 'code' END"


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS total, count(*) FILTER ({_KIND} = 'code') AS code, count(*) FILTER ({_KIND} = 'commentOnly') AS comment_only, count(*) FILTER ({_KIND} = 'blank') AS blank FROM lines GROUP BY doc_id")
def line_kinds(spark, d):
    kinds = classify.lines(t(spark, d, "documents"), "doc_id", "text").withColumn("kind", classify.line_kind(F.col("line_text")))
    return kinds.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("code", "code"), ("commentOnly", "comment_only"), ("blank", "blank"))))


@query(f"""WITH {_LINES}, ranges AS (SELECT doc_id, 2 + doc_id % 3 AS a, 4 + doc_id % 9 AS b FROM documents)
SELECT r.doc_id, a AS from_line, b AS to_line, count(line) AS sloc FROM ranges r LEFT JOIN (SELECT * FROM lines WHERE {_KIND} = 'code') l ON l.doc_id = r.doc_id AND line BETWEEN a AND b GROUP BY ALL""")
def range_sloc(spark, d):
    docs = t(spark, d, "documents")
    ranges = docs.select("doc_id", (2 + F.col("doc_id") % 3).alias("from_line"), (4 + F.col("doc_id") % 9).alias("to_line"))
    code = classify.lines(docs, "doc_id", "text").where(classify.line_kind(F.col("line_text")) == "code").select("doc_id", "line")
    hit = F.col("line").between(F.col("from_line"), F.col("to_line"))
    return ranges.join(code, "doc_id", "left").groupBy("doc_id", "from_line", "to_line").agg(F.count_if(hit).alias("sloc"))


@query("""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_kinds, sha256(array_to_string(w, ' ')) AS digest FROM (
SELECT doc_id, list_transform(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '0', 'g')) AS w FROM documents)""")
def token_normalize(spark, d):
    w = t(spark, d, "documents").select("doc_id", classify.normalised_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_kinds"), F.sha2(F.array_join("w", " "), 256).alias("digest"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def content_fingerprint(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))


@query("SELECT source, count(*) AS files, sha256(string_agg(doc_id || chr(9) || sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def snapshot_digest(spark, d):
    lines = t(spark, d, "documents").select("source", F.struct("doc_id", F.sha2("text", 256).alias("sha")).alias("f"))
    gathered = lines.groupBy("source").agg(F.count("*").alias("files"), F.sort_array(F.collect_list("f")).alias("fs"))
    return gathered.select("source", "files", F.sha2(F.array_join(F.transform("fs", lambda f: F.concat(f["doc_id"].cast("string"), F.lit("\t"), f["sha"])), "\n"), 256).alias("digest"))


@query("SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def coverage_by_scope(spark, d):
    return t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS uses FROM pages GROUP BY 1")
def external_usage(spark, d):
    return t(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count("*").alias("uses"))


@query("SELECT regexp_extract(CASE WHEN doc_id % 2 = 0 THEN '@' || lang || '/' || source || '/x' ELSE source || '/' || lang END, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package, count(*) AS imports FROM documents GROUP BY 1")
def package_names(spark, d):
    spec = F.expr("CASE WHEN doc_id % 2 = 0 THEN '@' || lang || '/' || source || '/x' ELSE source || '/' || lang END")
    return t(spark, d, "documents").groupBy(package_name(spec).alias("package")).agg(F.count("*").alias("imports"))


# --- duplication ---------------------------------------------------------------------------


def repeated_lines(spark, d) -> DataFrame:
    ls = classify.lines(t(spark, d, "documents"), "doc_id", "text").where(F.length("line_text") >= 20)
    return ls.groupBy("line_text").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("documents")).where("occurrences > 1")


@query(f"WITH {_LINES}, {_REPEATED} SELECT sha256(line_text) AS line_sha256, occurrences, documents FROM repeated")
def dup_line_union(spark, d):
    return repeated_lines(spark, d).select(F.sha2("line_text", 256).alias("line_sha256"), "occurrences", "documents")


K = 20
_WORDS = "w AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents)"
_GRAMS = f"""{_WORDS}, g AS (SELECT doc_id, lang, CAST(p AS INT) AS pos, array_to_string(w[p + 1:p + {K}], ' ') AS gram, CASE WHEN p > 0 THEN w[p] END AS before, w[p + {K} + 1] AS after FROM (SELECT *, unnest(range(0, len(w) - {K} + 1)) AS p FROM w))"""


def words() -> Column:
    return F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != "")


@query(f"""WITH {_GRAMS}, h AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM g WHERE (lang, gram) IN (SELECT (lang, gram) FROM g GROUP BY lang, gram HAVING count(*) > 1))
SELECT doc_id, lang, min(pos) AS start, max(pos) + {K} AS "end" FROM h GROUP BY doc_id, lang, i""")
def clone_runs(spark, d):
    return clones.repeated_spans(t(spark, d, "documents"), "doc_id", "lang", words(), K)


@query(f"""WITH {_GRAMS} SELECT lang, sha256(gram) AS gram_sha256, count(*) AS occurrences, count(DISTINCT doc_id) AS documents, count(DISTINCT coalesce(before, chr(10) || doc_id || ':' || pos)) AS left_contexts, count(DISTINCT coalesce(after, chr(10) || doc_id || ':' || pos)) AS right_contexts
FROM g GROUP BY lang, gram HAVING count(*) > 1""")
def clone_context_count(spark, d):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)  # a Python worker holds a whole batch of texts
    counted = clones.contexts(t(spark, d, "documents"), "doc_id", "lang", words(), K)
    return counted.select("lang", F.col("sha256").alias("gram_sha256"), "occurrences", "documents", "left_contexts", "right_contexts")


# All pairs of equal grams, joined along diagonals into maximal matches.
@query(f"""WITH {_GRAMS}, m AS (SELECT a.lang, a.doc_id AS d1, a.pos AS p1, b.doc_id AS d2, b.pos - a.pos AS gap FROM g a JOIN g b ON a.lang = b.lang AND a.gram = b.gram AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))),
i AS (SELECT *, p1 - row_number() OVER (PARTITION BY d1, d2, gap ORDER BY p1) AS i FROM m), r AS (SELECT lang, d1, d2, gap, min(p1) AS p1, CAST(count(*) + {K - 1} AS INT) AS n FROM i GROUP BY lang, d1, d2, gap, i),
o AS (SELECT lang, d1 AS doc_id, p1 AS pos, n FROM r UNION SELECT lang, d2, p1 + gap, n FROM r), c AS (SELECT o.*, CAST(doc_id AS VARCHAR) AS path, sha256(array_to_string(w[pos + 1:pos + n], ' ')) AS content FROM o JOIN w USING (doc_id, lang)),
x AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
u AS (SELECT lang, content, any_value(n) AS n, count(*) AS size, min(path) AS path, min((path, pos)) AS f FROM x GROUP BY lang, content HAVING count(*) > 1 AND bool_or(reach IS NULL OR reach < pos + n)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY path, n DESC, size DESC, f) AS id FROM u)
SELECT 'documents' AS repo, lang AS source_set, CAST(k.id AS INT) AS group_id, x.path, 1 AS start_line, 1 AS end_line, x.n AS token_count, x.pos AS start_token FROM x JOIN k USING (lang, content)""")
def clone_group_members(spark, d):
    """Maximal repeated word runs as groups of equal content, of every language whatever its size."""
    lines = F.transform(words(), lambda w: F.lit(1))
    docs = t(spark, d, "documents").select(F.lit("documents").alias("repo"), F.col("lang").alias("source_set"), F.col("doc_id").cast("string").alias("path"), words().alias("kinds"), lines.alias("start_lines"), lines.alias("end_lines"))
    return clone_groups.clone_members(docs, least=K, min_lines=1)


_SPANS = "iv AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS a, CAST(floor(epoch(ts)) AS BIGINT) // 3600 + 1 + event_id % 6 AS b FROM events)"


def event_spans(spark, d) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return t(spark, d, "events").select("user_id", hour.alias("a"), (hour + 1 + F.col("event_id") % 6).alias("b"))


@query(f"""WITH {_SPANS}, e AS (SELECT user_id, h, sum(x) AS x FROM (SELECT user_id, a AS h, 1 AS x FROM iv UNION ALL SELECT user_id, b + 1, -1 FROM iv) GROUP BY ALL),
c AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY h) >= 2 AS deep FROM e), z AS (SELECT *, coalesce(lag(deep) OVER (PARTITION BY user_id ORDER BY h), false) AS p FROM c), y AS (SELECT *, lead(h) OVER (PARTITION BY user_id ORDER BY h) AS nx FROM z WHERE deep <> p)
SELECT user_id, h AS from_at, nx - 1 AS to_at FROM y WHERE deep""")
def clone_overlap_spans(spark, d):
    return intervals.overlap_depth_spans(event_spans(spark, d), "user_id", "a", "b")


@query(f"""WITH {_SPANS} SELECT user_id, CAST(count(*) AS BIGINT) AS covered, CAST(count(*) FILTER (n) AS BIGINT) AS islands FROM (SELECT user_id, p, lag(p) OVER (PARTITION BY user_id ORDER BY p) IS DISTINCT FROM p - 1 AS n FROM (SELECT DISTINCT user_id, unnest(range(a, b + 1)) AS p FROM iv)) GROUP BY user_id""")
def interval_union(spark, d):
    return intervals.covered_positions(event_spans(spark, d), "user_id", "a", "b")


@query(f"""WITH {_SPANS}, u AS (SELECT DISTINCT user_id, a, b FROM iv) SELECT user_id, a, b, EXISTS (SELECT 1 FROM u y WHERE y.user_id = x.user_id AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b)) AS contained FROM u x""")
def containment(spark, d):
    return intervals.contained(event_spans(spark, d).distinct(), "user_id", "a", "b")


# --- graph ---------------------------------------------------------------------------------

_ORDER = "l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus, l_discount, l_tax"
_EDGES = f"raw AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS dst, l_quantity, l_returnflag FROM lineitem), e AS (SELECT * FROM raw WHERE dst IS NOT NULL)"


def supplier_edges(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))
    return t(spark, d, "lineitem").withColumn("dst", F.lead("l_suppkey").over(w)).where("dst IS NOT NULL").select(F.col("l_suppkey").alias("src"), "dst", "l_quantity", "l_returnflag")


@query(f"WITH {_EDGES} SELECT src, count(*) AS edges, count(DISTINCT dst) AS targets, count(*) FILTER (l_returnflag = 'R') AS type_only, count(*) FILTER (src = dst) AS loops FROM e GROUP BY src")
def graph_edges(spark, d):
    return supplier_edges(spark, d).groupBy("src").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("targets"), F.count_if(F.col("l_returnflag") == "R").alias("type_only"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


# A user's event types are the modules of a package; consecutive events are imports.
_TYPES = ["click", "error", "purchase", "signup", "view"]
_NODES = f"v AS (SELECT user_id, user_id * 10 + list_position({_TYPES}, event_type) AS node, event_type, ts, event_id FROM events)"
_STEPS = f"{_NODES}, s AS (SELECT DISTINCT src, dst FROM (SELECT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM v) WHERE dst IS NOT NULL)"
_SCC = f"{_STEPS}, r(a, b) AS (SELECT src, dst FROM s UNION SELECT r.a, s.dst FROM r JOIN s ON s.src = r.b), scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


def modules(spark, d) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type"))
    return t(spark, d, "events").select("user_id", (F.col("user_id") * 10 + place).cast("bigint").alias("node"), "event_type", "ts", "event_id")


def steps(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return checkpointed(modules(spark, d).select(F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst IS NOT NULL").distinct())


@query(f"WITH RECURSIVE {_SCC} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM scc")
def scc_groups(spark, d):
    members = checkpointed(graph.strong_components(steps(spark, d)))
    return members.join(members.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


@query(f"""WITH RECURSIVE {_SCC}, m AS (SELECT DISTINCT user_id, node FROM v) SELECT user_id, count(*) AS modules, count(component) AS affected, floor(count(component) / count(*) * 1e6 + 0.5) / 1e6 AS density,
array_to_string(list_sort(list(DISTINCT component) FILTER (component IS NOT NULL)), ',') AS groups FROM m LEFT JOIN scc USING (node) GROUP BY user_id""")
def cycle_density(spark, d):
    """By package: modules, those on a cycle, their share, and the groups (a package's, so few)."""
    nodes = modules(spark, d).select("user_id", "node").distinct().join(graph.strong_components(steps(spark, d)), "node", "left")
    groups = F.transform(F.array_sort(F.collect_set("component")), lambda x: x.cast("string"))
    views = nodes.groupBy("user_id").agg(F.count("*").alias("modules"), F.count("component").alias("affected"), F.when(F.count("component") > 0, F.array_join(groups, ",")).alias("groups"))
    return views.withColumn("density", half_up(F.col("affected") / F.col("modules"), 6))


@query(f"""WITH RECURSIVE {_SCC}, i AS (SELECT s.src, s.dst, a.component FROM s JOIN scc a ON a.node = s.src JOIN scc b ON b.node = s.dst AND a.component = b.component),
p(component, node, path) AS (SELECT component, dst, [src, dst] FROM i WHERE src = component UNION SELECT p.component, i.dst, list_append(p.path, i.dst) FROM p JOIN i ON i.component = p.component AND i.src = p.node AND p.node <> p.component AND (i.dst = p.component OR NOT list_contains(p.path, i.dst))),
k AS (SELECT component, path, row_number() OVER (PARTITION BY component ORDER BY len(path), path) AS k FROM p WHERE node = component)
SELECT component, CAST(len(path) - 1 AS BIGINT) AS length, array_to_string(path, ',') AS path FROM k WHERE k = 1""")
def shortest_cycle(spark, d):
    """The shortest cycle through each component's smallest node, the first by nodes of several."""
    edges = steps(spark, d)
    return graph.shortest_cycle(edges, graph.strong_components(edges)).select("component", (F.size("path") - 1).cast("bigint").alias("length"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(f"""WITH RECURSIVE {_STEPS}, r(node, depth) AS (SELECT DISTINCT node, 0 FROM v WHERE event_type = 'signup' UNION SELECT s.dst, r.depth + 1 FROM r JOIN s ON s.src = r.node WHERE r.depth < 6) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node""")
def ci_reach(spark, d):
    """Depth from the entry points (signups); a user has five nodes, so no depth is over four."""
    return graph.reach(steps(spark, d), modules(spark, d).where("event_type = 'signup'").select("node"))


_NAMED = "e AS (SELECT * FROM raw WHERE dst IS NOT NULL), n AS (SELECT DISTINCT src, dst, a.n_name AS from_name, b.n_name AS to_name, CASE WHEN l_returnflag = 'R' THEN 'type-only' ELSE 'runtime' END AS kind FROM e JOIN supplier x ON x.s_suppkey = src JOIN nation a ON a.n_nationkey = x.s_nationkey JOIN supplier y ON y.s_suppkey = dst JOIN nation b ON b.n_nationkey = y.s_nationkey)"
_BOUNDARY = f"""{_EDGES.split(', e AS')[0]}, {_NAMED},
w AS (SELECT *, unnest(['no-1-to-2', 'no-3-to-any']) AS rule FROM n WHERE NOT (regexp_matches(from_name, '_3$') AND regexp_matches(to_name, '_3$|_4$') AND kind = 'runtime')),
v AS (SELECT src, dst, from_name, to_name, kind, rule FROM w WHERE (rule = 'no-1-to-2' AND regexp_matches(from_name, '_1[0-9]$') AND regexp_matches(to_name, '_2$') AND kind = 'runtime') OR (rule = 'no-3-to-any' AND regexp_matches(from_name, '_3$') AND regexp_matches(to_name, '.')))"""
FORBIDDEN = [{"name": "no-1-to-2", "from": "_1[0-9]$", "to": "_2$", "edges": ["runtime"]}, {"name": "no-3-to-any", "from": "_3$", "to": "."}]
ALLOWED = [{"from": "_3$", "to": "_3$|_4$", "edges": ["runtime"]}]


@query(f"WITH {_BOUNDARY} SELECT * FROM v")
def boundary_rules(spark, d):
    names = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    kind = F.when(F.col("l_returnflag") == "R", "type-only").otherwise("runtime").alias("kind")
    e = supplier_edges(spark, d).select("src", "dst", kind).distinct()
    e = e.join(names.toDF("src", "from_name"), "src").join(names.toDF("dst", "to_name"), "dst").select("src", "dst", "from_name", "to_name", "kind")
    return graph.boundary_violations(e, FORBIDDEN, ALLOWED)


@query(f"WITH {_BOUNDARY} SELECT rule, kind, count(*) AS violations FROM v GROUP BY rule, kind")
def violations_by_rule(spark, d):
    return boundary_rules(spark, d).groupBy("rule", "kind").agg(F.count("*").alias("violations"))


# --- comparison, policy, history -----------------------------------------------------------

_SIDE = "SELECT l_returnflag || '.' || l_linestatus || '.' || CAST(l_linenumber AS VARCHAR) AS id, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS value FROM lineitem WHERE l_shipdate {} TIMESTAMP '1995-06-17' AND NOT (l_linenumber = {}) GROUP BY 1"


def half(spark, d, before: bool) -> DataFrame:
    at = F.lit("1995-06-17").cast("timestamp_ntz")
    rows = t(spark, d, "lineitem").where((F.col("l_shipdate").cast("timestamp_ntz") < at) if before else (F.col("l_shipdate").cast("timestamp_ntz") >= at)).where(F.col("l_linenumber") != (2 if before else 3))
    return rows.groupBy(F.concat_ws(".", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("id")).agg(F.sum("l_quantity").cast("bigint").cast("double").alias("value"))


@query(f"WITH a AS ({_SIDE.format('<', 2)}), b AS ({_SIDE.format('>=', 3)}) SELECT id, a.value AS baseline, b.value AS current, b.value - a.value AS delta, a.value IS DISTINCT FROM b.value AS changed FROM a FULL JOIN b USING (id)")
def metric_deltas(spark, d):
    return compare.metric_deltas(half(spark, d, True), half(spark, d, False))


_FIND = "SELECT CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS kind, CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS line FROM orders WHERE o_orderstatus = '{}'"


@query(f"""WITH a AS (SELECT *, count(*) OVER (PARTITION BY kind, path) AS n FROM ({_FIND.format('F')})), b AS (SELECT *, count(*) OVER (PARTITION BY kind, path) AS n FROM ({_FIND.format('O')})),
p AS (SELECT a.kind, a.path, b.line - a.line AS line_shift FROM a JOIN b ON a.kind = b.kind AND a.path = b.path WHERE a.n = 1 AND b.n = 1)
SELECT kind, path, 'persistent' AS status, line_shift FROM p UNION ALL SELECT kind, path, 'resolved', NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.kind = a.kind AND p.path = a.path) UNION ALL SELECT kind, path, 'new', NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.kind = b.kind AND p.path = b.path)""")
def finding_match(spark, d):
    found = t(spark, d, "orders").select("o_orderstatus", F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("kind"), F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("line"))
    return compare.match_findings(found.where("o_orderstatus = 'F'").drop("o_orderstatus"), found.where("o_orderstatus = 'O'").drop("o_orderstatus"))


@query(f"""WITH {_METRICS} SELECT 'metric-budget' AS policy, b.id AS subject, CASE WHEN m.state IS NULL THEN 'fail' WHEN m.value IS NULL THEN 'skipped' WHEN m.value > b.maximum THEN 'fail' ELSE 'pass' END AS status
FROM (VALUES ('erosion.eroded-share.production', 0.5), ('erosion.eroded-share.vendored', 0.1), ('erosion.eroded-count.test', 1e9), ('complexity.missing', 1.0)) b(id, maximum) LEFT JOIN metrics m USING (id)""")
def policy_budgets(spark, d):
    budgets = [("erosion.eroded-share.production", 0.5), ("erosion.eroded-share.vendored", 0.1), ("erosion.eroded-count.test", 1e9), ("complexity.missing", 1.0)]
    return compare.assess_budgets(spark.createDataFrame(budgets, "id string, maximum double"), native_metrics(spark, d))


_RUNS = "runs AS (SELECT user_id AS repo, event_id AS id, ts AS audited_at, event_type AS basis, CAST(floor(value) AS BIGINT) AS index FROM events)"


def runs(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("id"), F.col("ts").alias("audited_at"), F.col("event_type").alias("basis"), F.floor("value").alias("index"))


@query(f"WITH {_RUNS}, l AS (SELECT repo, basis, id, index AS current, lag(index) OVER (PARTITION BY repo, basis ORDER BY audited_at, id) AS baseline FROM runs) SELECT *, CASE WHEN baseline IS NULL THEN 'skipped' WHEN current - baseline > 20 OR current - baseline > baseline * 0.5 THEN 'fail' ELSE 'pass' END AS status FROM l")
def regression_policy(spark, d):
    scores = compare.index_deltas(runs(spark, d)).select("repo", "basis", "id", F.col("index").alias("current"), F.col("previous").alias("baseline"))
    return compare.assess_regression(scores, 20, 0.5)


@query(f"WITH {_RUNS} SELECT repo, id, basis, index FROM runs QUALIFY row_number() OVER (PARTITION BY repo ORDER BY audited_at DESC, id DESC) = 1")
def history_latest(spark, d):
    return compare.latest_runs(runs(spark, d)).drop("audited_at")


@query(f"WITH {_RUNS} SELECT repo, basis, id, index, lag(index) OVER w AS previous, index - lag(index) OVER w AS delta FROM runs WINDOW w AS (PARTITION BY repo, basis ORDER BY audited_at, id)")
def history_delta(spark, d):
    return compare.index_deltas(runs(spark, d)).drop("audited_at")


@query(f"WITH {_RUNS}, x AS (SELECT *, lag(basis) OVER (PARTITION BY repo ORDER BY audited_at, id) AS p FROM runs) SELECT repo, string_agg(basis, ' → ' ORDER BY audited_at, id) AS trend FROM x WHERE basis IS DISTINCT FROM p GROUP BY repo")
def history_trend(spark, d):
    return compare.trend_path(runs(spark, d), "basis")


@query("SELECT r_name AS target, count(*) AS audits, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'P') AS error, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) AS policy_failed FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def fleet_summary(spark, d):
    targets = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("target"))
    o = t(spark, d, "orders").join(targets, F.col("o_custkey") == F.col("c_custkey"))
    s = F.col("o_orderstatus")
    return o.groupBy("target").agg(F.count("*").alias("audits"), F.count_if(s == "F").alias("ok"), F.count_if(s == "P").alias("error"), F.count_if((s == "O") & (F.col("o_totalprice") > 200000)).alias("policy_failed"))


_DRIFT = """e AS (SELECT p_brand AS target, p_type AS path, CAST(max(p_size) AS VARCHAR) AS value FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), a AS (SELECT p_brand AS target, p_type AS path, CAST(max(p_size) AS VARCHAR) AS value FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL),
x AS (SELECT target, path, CASE WHEN a.value IS NULL THEN 'missing' WHEN e.value IS NULL THEN 'extra' WHEN e.value = a.value THEN 'match' WHEN starts_with(path, 'S') THEN 'allowed-delta' ELSE 'drift' END AS state FROM e FULL JOIN a USING (target, path))"""


@query(f"WITH {_DRIFT} SELECT target, " + ", ".join(f"count(*) FILTER (state = '{s}') AS \"{s}\"" for s in compare.DRIFT_STATES) + " FROM x GROUP BY target")
def drift_states(spark, d):
    side = lambda odd: t(spark, d, "part").where(F.col("p_partkey") % 2 == odd).groupBy(F.col("p_brand").alias("target"), F.col("p_type").alias("path")).agg(F.max("p_size").cast("string").alias("value"))
    states = compare.drift_states(side(0), side(1), ["S"])
    return states.groupBy("target").pivot("state", compare.DRIFT_STATES).agg(F.count(F.lit(1))).fillna(0)


@query("""WITH b AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS cases FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT cases, count(*) AS sites, min(l_orderkey) AS first_site FROM b GROUP BY cases HAVING count(*) > 1""")
def dispatch_families(spark, d):
    sets = t(spark, d, "lineitem").join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("cases"))
    return sets.groupBy("cases").agg(F.count("*").alias("sites"), F.min("l_orderkey").alias("first_site")).where("sites > 1")


@query("""SELECT 'duplicate-id' AS violation, CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'orphan-reference', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def contract_violations(spark, d):
    lines, orders = t(spark, d, "lineitem"), t(spark, d, "orders")
    twice = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate-id").alias("violation"), F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("subject"))
    orphans = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(F.lit("orphan-reference").alias("violation"), F.col("o_orderkey").cast("string").alias("subject"))
    return twice.unionByName(orphans)


_LEVELS = ["absent", "configured", "structurally-wired", "enforced"]


@query("""WITH r AS (SELECT l_suppkey AS surface, max(l_linenumber % 4) AS rank, count(DISTINCT l_returnflag) AS locations FROM lineitem GROUP BY l_suppkey) SELECT surface, ['absent', 'configured', 'structurally-wired', 'enforced'][rank + 1] AS evidence, locations FROM r""")
def safeguard_merge(spark, d):
    r = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("surface")).agg(F.max(F.col("l_linenumber") % 4).alias("rank"), F.count_distinct("l_returnflag").alias("locations"))
    return r.select("surface", F.element_at(F.array(*map(F.lit, _LEVELS)), F.col("rank") + 1).alias("evidence"), "locations")


@query("SELECT split_part(p_type, ' ', 1) AS prefix, count(*) AS files, floor(CAST(sum(p_size) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS mean_coverage FROM part GROUP BY 1")
def prefix_coverage(spark, d):
    return t(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("prefix")).agg(F.count("*").alias("files"), F.sum("p_size").alias("s")).select("prefix", "files", half_up(F.col("s").cast("double") / F.col("files"), 6).alias("mean_coverage"))


_BRANDS = "b AS (SELECT DISTINCT o_custkey AS site, p_brand AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


@query(f"""WITH {_BRANDS}, n AS (SELECT site, count(*) AS n FROM b GROUP BY site), p AS (SELECT x.site AS a, y.site AS b, count(*) AS shared FROM b x JOIN b y ON x.item = y.item AND x.site < y.site GROUP BY ALL)
SELECT p.a AS site_a, p.b AS site_b, shared FROM p JOIN n s ON s.site = p.a JOIN n t ON t.site = p.b WHERE shared >= 2 AND 3 * shared >= 2 * (s.n + t.n - shared) AND shared < s.n + t.n - shared""")
def dispatch_disagreement(spark, d):
    """Pairs of sites whose item sets nearly agree: 2/3 or more of all items, two at least, not equal."""
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("site"))
    items = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    return agreement.near_sets(t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(items, "l_partkey"))
