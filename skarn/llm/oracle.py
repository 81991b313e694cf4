"""DuckDB SQL of the queries whose whole result SQL can express: op2, op9, op11, op12 and op13."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from skarn.llm import balls, repair, sharding
from skarn.llm.chat import LLAMA, Template
from skarn.llm.jaccard import PERCENT, WORDS

OTHER_CODE = "x"
LETTERS = {"system": "s", "user": "u", "assistant": "a"}
# The default template's transitions and final state as regular expressions over these letters.
WHOLE, VIABLE = "s?(ua)+", "s?(ua)*u?"
PROBE_TEXT = "</s>[INST] ok [/INST]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _escapes(column: str, controls: list[str]) -> str:
    """Number of characters that escaping adds: one for a backslash and for the start of a control string
    (none begins another or overlaps itself, so taking them out one by one counts all)."""
    return " + ".join(f"(length({column}) - length(replace({column}, {_text(c)}, ''))) // {len(c)}" for c in ("\\", *controls))


def chat_sql(template: Template = LLAMA) -> str:
    """Digests of the turns as they are given; the length of the formatted text by counting what is added."""
    of = lambda value, other: "CASE role " + " ".join(f"WHEN {_text(name)} THEN {value(name, r)}" for name, r in template.roles.items()) + f" ELSE {other} END"
    markers = of(lambda _, r: len(r.opens) + len(r.closes), f"{sum(map(len, template.other))} + length(role) + {_escapes('role', template.controls)}")
    letters = of(lambda name, _: _text(LETTERS[name]), _text(OTHER_CODE))
    loss = of(lambda _, r: "text" if r.loss else "''", "''")
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {_text(PROBE_TEXT)}), (-7, 1, 'assistant', {_text(PROBE_TEXT)})
), gathered AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' {order}) AS whole,
    string_agg({loss}, '' {order}) AS loss_text,
    string_agg({letters}, '' {order}) AS roles,
    CAST(sum({markers} + length(text) + {_escapes('text', template.controls)}) AS BIGINT) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss_text) AS loss_chars, sha256(loss_text) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, '{WHOLE}') AS valid,
  CAST(CASE WHEN regexp_full_match(roles, '{VIABLE}') THEN 0 ELSE length(regexp_extract(roles, '^{VIABLE}')) + 1 END AS INTEGER) AS broken_at
FROM gathered"""


def jaccard_sql(words: int = WORDS, percent: int = PERCENT) -> str:
    """All pairs that share a shingle, counted exactly on the words themselves, and what links reach."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' ')) END) AS shingles FROM split
), sizes AS (
  SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM sets
), tokens AS (
  SELECT doc_id, unnest(shingles) AS token FROM sets
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n_shingles + y.n_shingles - shared)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(other) AS component_id FROM sizes JOIN reached USING (doc_id) GROUP BY doc_id"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes, one list step a byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda c, b: xor(c >> 8, CAST({table}[CAST(xor(c, b) & 255 AS INTEGER) + 1] AS BIGINT))), CAST(4294967295 AS BIGINT))"


def sharding_sql(shards: int = sharding.SHARDS) -> str:
    """The heap's dealing one group at a time; of groups of one weight the first by hash take the smallest shard dealt to them."""
    least = "list_position(d.loads, list_min(d.loads))"
    return f"""
WITH RECURSIVE content AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + {sharding.OVERHEAD} AS BIGINT) AS size FROM documents
), sums AS (
  SELECT text, {_crc32("text")} AS text_crc32 FROM (SELECT DISTINCT text FROM content)
), groups AS (
  SELECT text, sha256(text) AS key, CAST(sum(size) AS BIGINT) AS weight FROM content GROUP BY text
), numbered AS (
  SELECT text, key, weight, row_number() OVER (ORDER BY weight DESC, key) AS n FROM groups
), dealt AS (
  SELECT CAST(0 AS BIGINT) AS n, -1 AS shard, CAST(0 AS BIGINT) AS weight, list_transform(range({shards}), lambda i: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT g.n, CAST({least} - 1 AS INTEGER), g.weight, list_transform(d.loads, lambda x, i: x + CASE WHEN i = {least} THEN g.weight ELSE 0 END)
  FROM dealt d JOIN numbered g ON g.n = d.n + 1
), taken AS (
  SELECT weight, shard, row_number() OVER (PARTITION BY weight ORDER BY shard) AS k FROM dealt WHERE n > 0
), placed AS (
  SELECT text, shard FROM (SELECT text, weight, row_number() OVER (PARTITION BY weight ORDER BY key) AS k FROM groups) JOIN taken USING (weight, k)
)
SELECT doc_id, size, text_crc32, '{sharding.LAW}' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM content JOIN placed USING (text) JOIN sums USING (text)"""


def repair_sql() -> str:
    """The dynamic programme a turn at a time for each conversation, with whole edit strings."""
    way = lambda p, c, a: f"{{'cost': s[{p + 1}].cost + {c}, 'audit': s[{p + 1}].audit || '{repair.ADDED[a]}'}}"
    far = f"{{'cost': CAST({repair.FAR} AS BIGINT), 'audit': ''}}"
    layer = lambda letter: "[" + ", ".join(f"list_min([{', '.join([far, *(way(*w) for w in ways)])}])" for ways in repair.STEPS[letter]) + "]"
    layers = "CASE letter " + " ".join(f"WHEN '{letter}' THEN {layer(letter)}" for letter in repair.STEPS) + " END"
    start = "[" + ", ".join(["{'cost': CAST(0 AS BIGINT), 'audit': ''}", far, far, far]) + "]"
    ends = "list_min([" + ", ".join(f"{{'cost': s[{s + 1}].cost + {n * repair.INSERT}, 'audit': s[{s + 1}].audit || '{n * 'I'}'}}" for s, n in repair.ENDINGS.items()) + "])"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM filled, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged
), placed AS (
  SELECT *, row_number() OVER w AS position, lag(left(role, 1)) OVER w AS before, right(rtrim(text, {spaces}), 1) AS last
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
), lettered AS (
  SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS duplicate, last NOT IN ('', '.', '!', '?') AND nth = 1 AS truncated,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM placed
), turns AS (
  SELECT *, CASE WHEN blank OR duplicate THEN 'd' WHEN truncated THEN upper(initial) ELSE initial END AS letter FROM lettered
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), walked AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS position, {start} AS s FROM ids
  UNION ALL
  SELECT w.conv_id, t.position, {layers} FROM walked w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.position = w.position + 1
), ended AS (
  SELECT conv_id, arg_max(s, position) AS s FROM walked GROUP BY conv_id
), audits AS (
  SELECT conv_id, {ends} AS best FROM ended
), edits AS (
  SELECT conv_id, i, string_split(best.audit, '')[i] AS edit, len(replace(best.audit[1:i], 'I', '')) AS position FROM audits, range(1, len(best.audit) + 1) r(i)
), kept AS (
  SELECT e.conv_id, i, edit, role, text, edit = 'K' AND left(role, 1) = 's' AS system
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.position = e.position AND edit <> 'I' WHERE edit <> 'D'
), written AS (
  SELECT conv_id, i, CASE WHEN edit = 'K' THEN role WHEN sum(CASE WHEN system THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, coalesce(text, '') AS text FROM kept
), hashed AS (
  SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY i)) AS repaired_sha256 FROM written GROUP BY conv_id
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM audits a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM a.conv_id"""


def clusters_sql(clusters: int = balls.CLUSTERS, rounds: int = balls.ROUNDS, dimensions: int = balls.DIMENSIONS) -> str:
    """All distances in every round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""assigned{n} AS (
  SELECT row, vec_id, v, cluster, distance FROM (
    SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM kept, centroids{n})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1
)""")
        if n < rounds:
            steps.append(f"""means{n} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM assigned{n}, range(1, {dimensions + 1}) d(i) GROUP BY cluster, i) GROUP BY cluster
), centroids{n + 1} AS (
  SELECT o.cluster, CAST(coalesce(m.c, o.c) AS BIGINT[]) AS c FROM centroids{n} o LEFT JOIN means{n} m USING (cluster)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: greatest(least(CAST(floor({balls.SCALE} * CAST(x AS DOUBLE)) AS BIGINT), {balls.LIMIT}), -{balls.LIMIT})) AS v
  FROM embeddings WHERE len(embedding) = {dimensions} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))))
), centroids0 AS (
  SELECT CAST(n - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('{balls.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) AS n FROM kept) WHERE n <= {clusters}
), {", ".join(steps)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM assigned{rounds} JOIN centroids{rounds} USING (cluster)"""
