"""Evidence of external tools: paths, fragments, candidates, coverage, states, owners, requirements.

What the tools report comes in as tables; each operator is one plan over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUIVALENT = ("exact", "renamed")  # kinds of pairs whose fragments prove equality


def tidy_path(name: Column) -> Column:
    """Forward slashes, without a leading ``./``."""
    return F.regexp_replace(F.translate(name, "\\", "/"), r"^(\./)+", "")


def canonical_paths(names: DataFrame, selection: DataFrame) -> DataFrame:
    """Adds ``path`` to ``names`` (name): the selected path (path) that equals the name or is its longest
    suffix of whole segments; null if there is none.  Suffixes meet paths by equality."""
    parts = F.split(tidy_path(F.col("name")), "/")
    tails = names.select("name").distinct().withColumn("at", F.explode(F.sequence(F.lit(1), F.size(parts))))
    tails = tails.withColumn("path", F.array_join(F.slice(parts, F.col("at"), F.size(parts)), "/"))
    best = tails.join(selection.select("path").distinct(), "path").groupBy("name").agg(F.min_by("path", "at").alias("path"))
    return names.join(best, "name", "left")


def folded_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair, kind, fragment, place_a, place_b) with ``role``: ``group`` where two equivalent pairs or
    more exhibit one fragment at two places or more, ``degenerate`` where both places are one, else ``pair``;
    and ``members``, the number of a group's places."""
    equal = pairs.where(F.col("kind").isin(*EQUIVALENT))
    places = equal.select("fragment", F.explode(F.array("place_a", "place_b")).alias("place")).groupBy("fragment").agg(F.count_distinct("place").alias("members"))
    records = equal.groupBy("fragment").agg(F.count("*").alias("records"))
    groups = records.join(places, "fragment").where("records > 1 AND members > 1").select("fragment", "members")
    grouped = F.col("kind").isin(*EQUIVALENT) & F.col("members").isNotNull()
    role = F.when(grouped, "group").when(F.col("place_a") == F.col("place_b"), "degenerate").otherwise("pair")
    return pairs.join(groups, "fragment", "left").select("pair", role.alias("role"), F.when(grouped, F.col("members")).alias("members"))


def overlapping_members(members: DataFrame, key: list[str], start: str, end: str, order: str) -> DataFrame:
    """Adds ``overlaps``: the member shares a line with another one of its key."""
    w = Window.partitionBy(*key).orderBy(start, end, order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return members.withColumn("overlaps", F.coalesce(F.col(start) <= reach, F.lit(False)) | F.coalesce(F.lead(start).over(w) <= F.col(end), F.lit(False)))


def standing_candidates(candidates: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``candidates`` (category, path, symbol) with ``exempt_by``: the first declared public surface (path, export,
    place) that holds it, null if it stands.  A surface without an export holds its file's file, export and
    type candidates; one with an export the file candidate and the symbol of that name; neither an
    unresolved import."""
    s = surfaces.select(F.col("path").alias("_path"), F.col("export").alias("_export"), F.col("place").alias("_place"))
    symbol = F.col("category").isin("export", "type")
    holds = (F.col("category") == "file") | (symbol & (F.col("_export").isNull() | (F.col("_export") == F.col("symbol"))))
    keyed = candidates.select("category", "path", "symbol").distinct()
    name = F.concat(F.col("_path"), F.coalesce(F.concat(F.lit("#"), F.col("_export")), F.lit("")))
    by = keyed.join(s, F.col("path") == F.col("_path")).where(holds).groupBy("category", "path", "symbol").agg(F.min_by(name, "_place").alias("exempt_by"))
    c, b = candidates.alias("c"), by.alias("b")
    same = (F.col("c.category") == F.col("b.category")) & (F.col("c.path") == F.col("b.path")) & F.col("c.symbol").eqNullSafe(F.col("b.symbol"))
    return c.join(b, same, "left").select("c.*", "b.exempt_by")


def candidate_counts(standing: DataFrame) -> DataFrame:
    """One row: the standing candidates by category, all of them, and the exempt ones."""
    stands = F.col("exempt_by").isNull()
    kinds = {"files": "file", "exports": "export", "types": "type", "unresolved": "unresolved"}
    return standing.agg(*(F.count_if(stands & (F.col("category") == v)).alias(k) for k, v in kinds.items()), F.count_if(stands).alias("total"), F.count_if(~stands).alias("exempt"))


def graph_coverage(selected: DataFrame, represented: DataFrame) -> DataFrame:
    """path, status of all paths: ``represented``, ``missing`` (selected only) or ``stub`` (not selected)."""
    a = selected.select("path").distinct().withColumn("_a", F.lit(True))
    b = represented.select("path").distinct().withColumn("_b", F.lit(True))
    return a.join(b, "path", "full").select("path", F.when(F.col("_a").isNull(), "stub").when(F.col("_b").isNull(), "missing").otherwise("represented").alias("status"))


def compared_evidence(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """provider, status and reasons of each analysis (provider, state, semantics, content) on either side.

    ``unrequested`` if no side carries it, ``absent-on-baseline`` or ``-on-current`` if one does; a side that isn't
    complete is a state gap and nothing is compared; nor if the semantics of the two differ; a content
    that differs is a caveat only."""
    a, b = (x.select("provider", *(F.col(c).alias(f"{c}_{s}") for c in ("state", "semantics", "content"))) for x, s in ((baseline, "a"), (current, "b")))
    kind = lambda s: F.when(F.col(f"state_{s}").isNull() | (F.col(f"state_{s}") == "unrequested"), "absent").when((F.col(f"state_{s}") == "complete") & F.col(f"semantics_{s}").isNotNull(), "complete").otherwise("gap")
    both = a.join(b, "provider", "full").withColumns({"kind_a": kind("a"), "kind_b": kind("b")})
    none_a, none_b, gap_a, gap_b = F.col("kind_a") == "absent", F.col("kind_b") == "absent", F.col("kind_a") == "gap", F.col("kind_b") == "gap"
    gap = gap_a | gap_b
    same = F.col("semantics_a") == F.col("semantics_b")
    status = F.when(none_a & none_b, "unrequested").when(none_a, "absent-on-baseline").when(none_b, "absent-on-current").when(~gap & same, "comparable").otherwise("noncomparable")
    reason = F.when(none_a & none_b, F.lit("")).when(none_a | none_b, "not-carried").when(gap_a & gap_b, "state-gap baseline,state-gap current").when(gap_a, "state-gap baseline").when(gap_b, "state-gap current").when(~same, "semantics-changed").otherwise("")
    caveat = F.when((status == "comparable") & ~F.col("content_a").eqNullSafe(F.col("content_b")), "input-revision-changed").otherwise("")
    return both.select("provider", status.alias("status"), reason.alias("reasons"), caveat.alias("caveats"))


def namespace_owner(ids: DataFrame, providers: DataFrame, separator: str = ".") -> DataFrame:
    """Adds ``owner`` to ``ids`` (id): the longest provider (provider) that the id is or is a name within."""
    parts = F.split("id", F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    heads = ids.select("id").distinct().withColumn("at", F.explode(F.sequence(F.lit(1), F.size(parts))))
    heads = heads.withColumn("provider", F.array_join(F.slice(parts, F.lit(1), F.col("at")), separator))
    best = heads.join(providers.select("provider").distinct(), "provider").groupBy("id").agg(F.max_by("provider", "at").alias("owner"))
    return ids.join(best, "id", "left")


def required_evidence(required: DataFrame, carried: DataFrame, capabilities: DataFrame) -> DataFrame:
    """provider, status, code of each required analysis: a pass only if it is carried and complete.  A gap, one
    that wasn't requested, one that can't be and an unknown one fail, each with its code."""
    rows = required.select("provider").distinct().join(carried.select("provider", "state"), "provider", "left").join(capabilities.select("provider", "supported"), "provider", "left")
    complete = F.coalesce(F.col("state") == "complete", F.lit(False))
    code = F.when(complete, F.lit(None)).when(F.col("state").isNotNull(), F.concat(F.lit("requirement-evidence-"), "state")).when(F.col("supported").isNull(), "requirement-analysis-unknown").when(~F.col("supported"), "requirement-evidence-unsupported").otherwise("requirement-analysis-unrequested")
    return rows.select("provider", F.when(complete, "pass").otherwise("fail").alias("status"), code.alias("code"))


def named_examples(rows: DataFrame, key: list[str], name: str, n: int = 5) -> DataFrame:
    """Per key the first ``n`` names and how many more there are, as a message.  Only ``n`` rows of a key and
    partition are ever held: they are chosen before and after the shuffle."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("_all"))
    first = Window.partitionBy(*key).orderBy(name)
    chosen = rows.select(*key, name).withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= n)
    texts = chosen.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(name).cast("string").alias("x")))), lambda s: s["x"]), ", ").alias("_names"))
    more = F.col("_all") - n
    return counts.join(texts, key).select(*key, F.col("_all").alias("n"), F.when(more > 0, F.concat("_names", F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.col("_names")).alias("message"))


def coverage_fingerprint(scope: DataFrame, key: list[str], name: str) -> DataFrame:
    """Per key one digest of all names, whatever their order: of the digests of 256 buckets of names, so
    that no row holds all names of a key."""
    bucket = F.substring(F.sha2(F.col(name).cast("string"), 256), 1, 2)
    parts = scope.select(*key, bucket.alias("_bucket"), F.col(name).cast("string").alias("_name")).distinct().groupBy(*key, "_bucket")
    parts = parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_name")), "\n"), 256).alias("_part"))
    return parts.groupBy(*key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_part"))), lambda s: s["_part"]), "\n"), 256).alias("fingerprint"))


def verified(declared: DataFrame, found: DataFrame) -> DataFrame:
    """path, status of each declared file (path, sha256) against what was found (path, sha256; null if it
    can't be read): ``match``, ``changed``, ``unreadable`` or ``missing``."""
    f = found.select("path", F.col("sha256").alias("_now"), F.lit(True).alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_now").isNull(), "unreadable").when(F.col("_now") == F.col("sha256"), "match").otherwise("changed")
    return declared.join(f, "path", "left").select("path", status.alias("status"))


def fleet_assessment(targets: DataFrame) -> DataFrame:
    """target, reason of each target (target, ok, error, failed, messages) that fails the fleet: it couldn't be
    audited, or its policy failed."""
    reason = F.when(~F.col("ok"), F.concat_ws(": ", "target", "error")).when(F.col("failed"), F.concat(F.col("target"), F.lit(": policy failed — "), F.array_join("messages", "; ")))
    return targets.select("target", reason.alias("reason")).where("reason IS NOT NULL")
