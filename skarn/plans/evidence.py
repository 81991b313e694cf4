"""Queries of the evidence and repository operators over the star-schema and text tables, with their SQL.

Brands and part types stand for folders, customers and nations for analyses and targets, orders for what
they report; two periods are the two sides of a comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import evidence, repository
from skarn.plans.catalogue import query, t

_SELECTION = "sel AS (SELECT DISTINCT lower(p_type) || '/' || p_name AS path FROM part UNION SELECT DISTINCT lower(p_brand) || '/' || lower(p_type) || '/' || p_name FROM part WHERE p_size > 25)"


@query(f"""WITH {_SELECTION}, n AS (SELECT p_partkey, './checkout\\' || lower(p_brand) || '/' || lower(p_type) || '/' || p_name AS name FROM part),
m AS (SELECT name, arg_max(path, length(path)) AS path FROM (SELECT DISTINCT name FROM n) JOIN sel ON ends_with('/' || regexp_replace(replace(name, '\\', '/'), '^(\\./)+', ''), '/' || path) GROUP BY name)
SELECT p_partkey, path FROM n LEFT JOIN m USING (name)""")
def canonical_path(spark, d):
    part = t(spark, d, "part")
    kind, name, brand = F.lower("p_type"), F.col("p_name"), F.lower("p_brand")
    selection = part.select(F.concat_ws("/", kind, name).alias("path")).union(part.where("p_size > 25").select(F.concat_ws("/", brand, kind, name)))
    return evidence.canonical_paths(part.select("p_partkey", F.concat(F.lit("./checkout\\"), F.concat_ws("/", brand, kind, name)).alias("name")), selection).select("p_partkey", "path")


@query("""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS pair, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'renamed' ELSE 'near' END AS kind, l_partkey * 100 + CAST(l_quantity AS BIGINT) AS fragment, l_suppkey % 10 AS place_a, l_linenumber AS place_b FROM lineitem),
e AS (SELECT * FROM p WHERE kind <> 'near'), g AS (SELECT fragment, count(*) AS members FROM (SELECT fragment, place_a AS x FROM e UNION SELECT fragment, place_b FROM e) GROUP BY 1),
c AS (SELECT fragment FROM e GROUP BY 1 HAVING count(*) > 1), k AS (SELECT g.* FROM g JOIN c USING (fragment) WHERE members > 1)
SELECT kind, CASE WHEN kind <> 'near' AND members IS NOT NULL THEN 'group' WHEN place_a = place_b THEN 'degenerate' ELSE 'pair' END AS role, count(*) AS pairs, CAST(sum(CASE WHEN kind <> 'near' THEN members END) AS BIGINT) AS members FROM p LEFT JOIN k USING (fragment) GROUP BY ALL""")
def fragment_groups(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "renamed").otherwise("near")
    pairs = t(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair"), kind.alias("kind"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("bigint")).alias("fragment"), (F.col("l_suppkey") % 10).cast("bigint").alias("place_a"), F.col("l_linenumber").cast("bigint").alias("place_b")
    )
    roles = evidence.folded_pairs(pairs.withColumn("pair", F.struct("pair", "kind")))
    return roles.groupBy(F.col("pair.kind").alias("kind"), "role").agg(F.count("*").alias("pairs"), F.sum("members").alias("members"))


_SPANS = "s AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS BIGINT) AS a, CAST(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) + floor(o_totalprice / 10000) AS BIGINT) AS b FROM orders)"


def order_spans(spark, d):
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("a"), (day + F.floor(F.col("o_totalprice") / 10000)).cast("bigint").alias("b"))


@query(f"WITH {_SPANS} SELECT o_orderkey, EXISTS (SELECT 1 FROM s y WHERE y.o_custkey = x.o_custkey AND y.o_orderkey <> x.o_orderkey AND y.a <= x.b AND x.a <= y.b) AS overlaps FROM s x")
def overlapping_members(spark, d):
    return evidence.overlapping_members(order_spans(spark, d), ["o_custkey"], "a", "b", "o_orderkey").select("o_orderkey", "overlaps")


@query(f"WITH {_SPANS}, f AS (SELECT o_custkey, EXISTS (SELECT 1 FROM s y WHERE y.o_custkey = x.o_custkey AND y.o_orderkey <> x.o_orderkey AND y.a <= x.b AND x.a <= y.b) AS o FROM s x) SELECT o_custkey, count(*) AS members, bool_or(o) AS overlaps FROM f GROUP BY o_custkey")
def group_overlap(spark, d):
    members = evidence.overlapping_members(order_spans(spark, d), ["o_custkey"], "a", "b", "o_orderkey")
    return members.groupBy("o_custkey").agg(F.count("*").alias("members"), F.bool_or("overlaps").alias("overlaps"))


_KINDS = ["file", "export", "type", "unresolved"]
_CANDIDATES = f"""c AS (SELECT p_partkey, {_KINDS}[p_size % 4 + 1] AS category, p_brand AS path, CASE WHEN p_size % 4 > 0 THEN p_name END AS symbol FROM part),
u AS (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) AS path, CASE WHEN n_regionkey > 1 THEN (SELECT min(p_name) FROM part) END AS export, n_nationkey AS place FROM nation WHERE n_regionkey > 0),
x AS (SELECT p_partkey, arg_min(u.path || coalesce('#' || export, ''), place) AS exempt_by FROM c JOIN u USING (path) WHERE category = 'file' OR (category IN ('export', 'type') AND (export IS NULL OR export = symbol)) GROUP BY p_partkey)"""


def candidates(spark, d):
    part, nation = t(spark, d, "part"), t(spark, d, "nation")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_size") % 4 + 1).cast("int"))
    rows = part.select("p_partkey", kind.alias("category"), F.col("p_brand").alias("path"), F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("symbol"))
    least = part.agg(F.min("p_name").alias("least"))  # one row
    surfaces = nation.where("n_regionkey > 0").crossJoin(F.broadcast(least)).select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("path"), F.when(F.col("n_regionkey") > 1, F.col("least")).alias("export"), F.col("n_nationkey").alias("place"))
    return evidence.standing_candidates(rows, surfaces)


@query(f"WITH {_CANDIDATES} SELECT p_partkey, category, exempt_by FROM c LEFT JOIN x USING (p_partkey)")
def exempt_candidates(spark, d):
    return candidates(spark, d).select("p_partkey", "category", "exempt_by")


@query(f"WITH {_CANDIDATES}, y AS (SELECT * FROM c LEFT JOIN x USING (p_partkey)) SELECT " + ", ".join(f"count(*) FILTER (exempt_by IS NULL AND category = '{k}') AS {n}" for k, n in zip(_KINDS, ("files", "exports", "types", "unresolved"), strict=True)) + ", count(*) FILTER (exempt_by IS NULL) AS total, count(exempt_by) AS exempt FROM y")
def candidate_counts(spark, d):
    return evidence.candidate_counts(candidates(spark, d))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS path FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS path FROM orders WHERE o_orderstatus = 'O')
SELECT path, CASE WHEN a.path IS NULL THEN 'stub' WHEN b.path IS NULL THEN 'missing' ELSE 'represented' END AS status FROM a FULL JOIN b USING (path)""")
def graph_coverage(spark, d):
    by = lambda s: t(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("path"))
    return evidence.graph_coverage(by("F"), by("O"))


_EVIDENCE = "SELECT o_custkey AS provider, CASE max(o_orderstatus) WHEN 'P' THEN 'complete' WHEN 'O' THEN CASE WHEN count(*) > 1 THEN 'complete' ELSE 'unrequested' END ELSE 'partial' END AS state, min(o_orderpriority) AS semantics, max(o_orderkey) AS content FROM orders WHERE o_orderdate {} TIMESTAMP '1997-01-01' GROUP BY 1"


def period(spark, d, before: bool):
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    top, n = F.max("o_orderstatus"), F.count("*")
    state = F.when(top == "P", "complete").when(top == "O", F.when(n > 1, "complete").otherwise("unrequested")).otherwise("partial")
    return t(spark, d, "orders").where(at < cut if before else at >= cut).groupBy(F.col("o_custkey").alias("provider")).agg(state.alias("state"), F.min("o_orderpriority").alias("semantics"), F.max("o_orderkey").alias("content"))


@query(f"""WITH a AS ({_EVIDENCE.format('<')}), b AS ({_EVIDENCE.format('>=')}), j AS (SELECT provider, a.state AS s, b.state AS u, a.semantics = b.semantics AS same, a.content IS DISTINCT FROM b.content AS moved FROM a FULL JOIN b USING (provider)),
k AS (SELECT *, coalesce(s, 'unrequested') = 'unrequested' AS na, coalesce(u, 'unrequested') = 'unrequested' AS nb, coalesce(s, '') = 'partial' AS ga, coalesce(u, '') = 'partial' AS gb FROM j),
r AS (SELECT *, CASE WHEN na AND nb THEN 'unrequested' WHEN na THEN 'absent-on-baseline' WHEN nb THEN 'absent-on-current' WHEN NOT ga AND NOT gb AND same THEN 'comparable' ELSE 'noncomparable' END AS status FROM k)
SELECT provider, status, CASE WHEN na AND nb THEN '' WHEN na OR nb THEN 'not-carried' WHEN ga AND gb THEN 'state-gap baseline,state-gap current' WHEN ga THEN 'state-gap baseline' WHEN gb THEN 'state-gap current' WHEN NOT same THEN 'semantics-changed' ELSE '' END AS reasons,
CASE WHEN status = 'comparable' AND moved THEN 'input-revision-changed' ELSE '' END AS caveats FROM r""")
def compared_evidence(spark, d):
    return evidence.compared_evidence(period(spark, d, True), period(spark, d, False))


@query("""WITH i AS (SELECT p_partkey, lower(p_brand) || '.' || lower(p_type) || '.' || p_name AS id FROM part), p AS (SELECT DISTINCT lower(p_brand) AS provider FROM part UNION SELECT DISTINCT lower(p_brand) || '.' || lower(p_type) FROM part WHERE p_size = 50)
SELECT p_partkey, max_by(provider, length(provider)) AS owner FROM i LEFT JOIN p ON id = provider OR starts_with(id, provider || '.') GROUP BY p_partkey""")
def namespace_owner(spark, d):
    part = t(spark, d, "part")
    brand, within = F.lower("p_brand"), F.concat_ws(".", F.lower("p_brand"), F.lower("p_type"))
    providers = part.select(brand.alias("provider")).union(part.where("p_size = 50").select(within))
    return evidence.namespace_owner(part.select("p_partkey", F.concat_ws(".", within, "p_name").alias("id")), providers).select("p_partkey", "owner")


@query("""WITH s AS (SELECT s_nationkey, max(s_acctbal) AS m FROM supplier GROUP BY 1), x AS (SELECT n_name AS provider, CASE WHEN m > 9500 THEN 'complete' WHEN m > 5000 THEN 'partial' WHEN m IS NOT NULL THEN 'failed' END AS state, CASE WHEN n_regionkey <> 3 THEN n_regionkey <> 2 END AS supported FROM nation LEFT JOIN s ON s_nationkey = n_nationkey AND n_regionkey < 2)
SELECT provider, CASE WHEN state = 'complete' THEN 'pass' ELSE 'fail' END AS status, CASE WHEN state = 'complete' THEN NULL WHEN state IS NOT NULL THEN 'requirement-evidence-' || state WHEN supported IS NULL THEN 'requirement-analysis-unknown' WHEN NOT supported THEN 'requirement-evidence-unsupported' ELSE 'requirement-analysis-unrequested' END AS code FROM x""")
def required_evidence(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_name").alias("provider"), "n_nationkey", "n_regionkey")
    top = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("m"))
    carried = nation.where("n_regionkey < 2").join(top, "n_nationkey").select("provider", F.when(F.col("m") > 9500, "complete").when(F.col("m") > 5000, "partial").otherwise("failed").alias("state"))
    return evidence.required_evidence(nation, carried, nation.where("n_regionkey <> 3").select("provider", (F.col("n_regionkey") != 2).alias("supported")))


@query("""WITH o AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS x FROM orders GROUP BY 1) SELECT o_custkey, len(x) AS n, array_to_string(x[1:5], ', ') || CASE WHEN len(x) > 5 THEN ', +' || CAST(len(x) - 5 AS VARCHAR) || ' more' ELSE '' END AS message FROM o""")
def named_examples(spark, d):
    return evidence.named_examples(t(spark, d, "orders"), ["o_custkey"], "o_orderkey")


@query("""WITH b AS (SELECT c_nationkey, substr(sha256(c_name), 1, 2) AS k, sha256(string_agg(c_name, chr(10) ORDER BY c_name)) AS p FROM (SELECT DISTINCT c_nationkey, c_name FROM customer) GROUP BY 1, 2) SELECT c_nationkey, sha256(string_agg(p, chr(10) ORDER BY k)) AS fingerprint FROM b GROUP BY 1""")
def coverage_fingerprint(spark, d):
    return evidence.coverage_fingerprint(t(spark, d, "customer"), ["c_nationkey"], "c_name")


@query("""WITH f AS (SELECT doc_id, CASE WHEN n_chars >= 200 THEN sha256(text) END AS sha FROM documents JOIN labels USING (doc_id))
SELECT doc_id AS path, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN sha IS NULL THEN 'unreadable' WHEN sha = sha256(lower(text)) THEN 'match' ELSE 'changed' END AS status FROM documents LEFT JOIN f USING (doc_id)""")
def manifest_states(spark, d):
    docs = t(spark, d, "documents")
    found = docs.join(t(spark, d, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("path"), F.when(F.col("n_chars") >= 200, F.sha2("text", 256)).alias("sha256"))
    return evidence.verified(docs.select(F.col("doc_id").alias("path"), F.sha2(F.lower("text"), 256).alias("sha256")), found)


@query("""WITH m AS (SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal < -900)), '; ') AS messages FROM customer GROUP BY 1)
SELECT n_name AS target, CASE WHEN n_regionkey = 1 THEN n_name || ': unreadable' ELSE n_name || ': policy failed — ' || messages END AS reason FROM nation LEFT JOIN m ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR coalesce(messages, '') <> ''""")
def fleet_assessment(spark, d):
    low = F.array_sort(F.collect_set(F.when(F.col("c_acctbal") < -900, F.col("c_mktsegment"))))
    by = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(low.alias("messages"))
    targets = t(spark, d, "nation").join(by, "n_nationkey", "left").select(F.col("n_name").alias("target"), (F.col("n_regionkey") != 1).alias("ok"), F.lit("unreadable").alias("error"), (F.coalesce(F.size("messages"), F.lit(0)) > 0).alias("failed"), "messages")
    return evidence.fleet_assessment(targets)


_MARKER = "(?:^|[^A-Za-z0-9_])(token|secret|password|license)(?:[^A-Za-z0-9_]|$)"
_LINES = "l AS (SELECT doc_id AS path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS x FROM documents))"


@query(f"""WITH {_LINES}, f AS (SELECT path, line, regexp_extract(text, '{_MARKER}', 1) AS marker FROM l WHERE regexp_matches(text, '{_MARKER}') AND NOT regexp_matches(text, 'https?:')), a AS (SELECT doc_id AS path, 1 AS line FROM labels WHERE toxic = 0)
SELECT 'marker' AS what, path, line, marker FROM f ANTI JOIN a USING (path, line) UNION ALL SELECT 'stale', path, line, NULL FROM a ANTI JOIN f USING (path, line)""")
def debt_markers(spark, d):
    files = t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    allowed = t(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("path"), F.lit(1).alias("line"))
    found, stale = repository.debt_markers(files, "https?:", allowed, ("token", "secret", "password", "license"))
    rows = found.select(F.lit("marker").alias("what"), "path", "line", "marker").union(stale.select(F.lit("stale"), "path", "line", F.lit(None).cast("string")))
    return rows.withColumn("line", F.col("line").cast("bigint"))


@query("""WITH s AS (SELECT doc_id AS path, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n')) END AS lines FROM documents), b AS (SELECT doc_id AS path, 2 + quality AS budget FROM labels)
SELECT path, lines, CAST(coalesce(budget, 4) AS BIGINT) AS budget FROM s LEFT JOIN b USING (path) WHERE lines > coalesce(budget, 4)""")
def size_breaches(spark, d):
    files = t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    budgets = t(spark, d, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") + 2).cast("bigint").alias("budget"))
    return repository.size_breaches(files, budgets, 4)[0]


@query("""SELECT 'u' || CAST(user_id AS VARCHAR) AS file, count(*) AS cases, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS seconds FROM events GROUP BY 1 ORDER BY seconds DESC, file LIMIT 20""")
def slowest_tests(spark, d):
    """The twenty files with the longest tests, out of JUnit reports."""
    tag = F.format_string('<testsuite><testcase name="e%d" file="u%d" time="%s"/></testsuite>', "event_id", "user_id", F.col("value").cast("string"))
    return repository.slowest(repository.test_cases(t(spark, d, "events").select(tag.alias("text"))), 20)


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS functions, CAST(sum(l_linenumber) AS BIGINT) AS functions_hit, CAST(sum(l_suppkey) AS BIGINT) AS lines, CAST(sum(l_partkey) AS BIGINT) AS lines_hit FROM lineitem")
def line_coverage(spark, d):
    report = F.format_string("SF:x\nFNF:%d\nFNH:%d\nLF:%d\nLH:%d\nend_of_record\n", F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint"), "l_suppkey", "l_partkey")
    return repository.line_coverage(t(spark, d, "lineitem").select(report.alias("text")))


@query("SELECT event_type, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, count(*) AS runs FROM events GROUP BY event_type")
def run_medians(spark, d):
    return repository.medians(t(spark, d, "events"), ["event_type"], "value")


_OPS = ["eq", "gt", "ge", "lt", "le"]


@query(f"""WITH v AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 5000) AS a, count(*) FILTER (c_acctbal <= 5000) AS b FROM customer GROUP BY 1), x AS (SELECT n_name AS id, {_OPS}[n_regionkey + 1] AS op, 3 AS expected, a, b FROM nation LEFT JOIN v ON c_nationkey = n_nationkey)
SELECT id, op, coalesce(CASE op WHEN 'eq' THEN a = expected WHEN 'gt' THEN a > expected WHEN 'ge' THEN a >= expected WHEN 'lt' THEN a < expected ELSE a <= expected END, false) AS passes, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN b < a THEN 'decrease' WHEN b > a THEN 'increase' ELSE 'unchanged' END AS change FROM x""")
def corpus_checks(spark, d):
    rich = F.col("c_acctbal") > 5000
    counts = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(rich).alias("value"), F.count_if(~rich).alias("after"))
    nation = t(spark, d, "nation")
    checks = nation.select(F.col("n_name").alias("id"), F.element_at(F.array(*map(F.lit, _OPS)), (F.col("n_regionkey") + 1).cast("int")).alias("op"), F.lit(3).alias("expected"))
    values = counts.join(nation, "n_nationkey").select(F.col("n_name").alias("id"), "value", "after")
    return repository.checked_expectations(checks, values).select("id", "op", "passes", repository.paired_change(F.col("value"), F.col("after")).alias("change"))


@query("SELECT c_custkey, c_mktsegment || '#' || substr(sha256(c_name), 1, 12) AS identity, replace(c_name || ' of ' || c_mktsegment, c_mktsegment, '[redacted]') AS output FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'BUILDING')")
def repository_identities(spark, d):
    """Of two segments, whose names are the sensitive values."""
    names = ["HOUSEHOLD", "BUILDING"]
    rows = t(spark, d, "customer").where(F.col("c_mktsegment").isin(*names))
    return rows.select("c_custkey", repository.repository_identity(F.col("c_mktsegment"), F.col("c_name")).alias("identity"), repository.scrubbed(F.concat_ws(" of ", "c_name", "c_mktsegment"), names).alias("output"))
