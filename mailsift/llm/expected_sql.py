"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from mailsift.llm import merkle, mixing, quality_rules as rules, resampling

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(
    CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

OP5 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
      + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))) AS chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""


def _line_kept(line: str) -> str:
    def has(pattern: str) -> str:
        return f"regexp_matches({line}, {_text(pattern)})"

    failed = " AND ".join(f"NOT {has(p)}" for p in (rules.NOISE, rules.NAVIGATION, rules.BOILERPLATE))
    return f"(({has(rules.ENDED)} OR {has(rules.LONG)}) AND {failed})"


OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, {_WORDS}) AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_text(rules.HAS_WORD)})) AS ls
  FROM d),
windows AS (
  SELECT doc_id, unnest(range(0, len(ws) - {rules.WINDOW - 1})) AS i, ws FROM w WHERE len(ws) >= {rules.WINDOW}),
named AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i+1:i+{rules.WINDOW}], ' ')) AS n
  FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {rules.WINDOW})) AS p FROM named WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, {_text(rules.SYMBOLS)})) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    list_filter(ls, lambda x: {_line_kept("x")}) AS ks,
    length(array_to_string(ls, '')) AS all_chars
  FROM w LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * (all_chars - length(array_to_string(ks, ''))) > {rules.MAX_LOST} * all_chars) AS kept,
  n_lines, CAST(len(ks) AS BIGINT) AS n_lines_kept
FROM f
"""


def _crc(value: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text; needs ``crc_table`` in the FROM clause."""
    octets = f"list_transform(range(strlen({value})), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, {step}), 4294967295)"


_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps)"""


def _features(name: str, table: str) -> str:
    letters = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
{name}_words AS (
  SELECT row_number() OVER () AS row, *, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {letters}) AS ws
  FROM {table}),
{name} AS (
  SELECT row, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS feature FROM {name}_words)"""


_N = resampling.BUCKETS
OP11 = f"""
WITH {_CRC_TABLE},
{_features("docs", "documents")},
{_features("target", "benchmark")},
named AS (
  SELECT feature, {_crc("feature")} % {_N} AS bucket
  FROM (SELECT feature FROM docs UNION SELECT feature FROM target), crc_table),
s AS (SELECT bucket, count(*) AS n FROM docs JOIN named USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN named USING (feature) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM docs) + {_N})
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM target) + {_N})))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
summed AS (
  SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total
  FROM docs JOIN named USING (feature) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    ('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT AS h
  FROM docs_words LEFT JOIN summed USING (row)),
noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT *, n_words >= {resampling.MIN_WORDS} AND doc_id IS NOT NULL AS takes_part,
    row_number() OVER (PARTITION BY n_words >= {resampling.MIN_WORDS} AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place
  FROM noisy)
SELECT doc_id, n_features, weight, score,
  CASE WHEN takes_part AND place <= {resampling.PERCENT} * (SELECT count(*) FROM ranked WHERE takes_part) // 100 THEN place END AS rank
FROM ranked
"""

OP12 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
    sha256('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, {mixing.MAX_EPOCHS} * source_size AS most,
    row_number() OVER (ORDER BY {mixing.MAX_EPOCHS} * source_size / weight, source NULLS LAST) AS place
  FROM sources),
remaining AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS DOUBLE) AS words_left,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS weight_left
  FROM ordered WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT words_left, weight_left, place AS first FROM remaining
  WHERE most * weight_left > weight * words_left ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN place < coalesce(first, 1000000) THEN CAST(most AS DOUBLE) ELSE weight * level.words_left / level.weight_left END AS target
  FROM remaining LEFT JOIN level ON true),
placed AS (
  SELECT sized.*, source_size, target, CAST(floor(target) AS BIGINT) AS goal,
    CAST(coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY hash, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0
    ELSE goal // source_size * size + greatest(0, least(size, goal % source_size - start)) END AS taken
FROM placed
"""


def _levels(name: str, first: str, n_levels: int) -> str:
    """Tables ``{name}0`` up to the roots, and ``{name}_path`` of each leaf's siblings by level."""
    parts = [f"{name}0 AS ({first})"]
    for k in range(n_levels):
        parts.append(f"""{name}_runs{k} AS (
  SELECT tree, pos // {merkle.FANOUT} AS pos, n, list(digest ORDER BY pos) AS ds FROM {name}{k} GROUP BY tree, pos // {merkle.FANOUT}, n)""")
        parts.append(f"""{name}{k + 1} AS (
  SELECT tree, pos, CAST(ceil(n / {merkle.FANOUT}) AS BIGINT) AS n,
    CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS digest FROM {name}_runs{k})""")
    steps, joins, at = [], [], "l.pos"
    for k in range(n_levels):
        joins.append(f"JOIN {name}_runs{k} r{k} ON r{k}.tree = l.tree AND r{k}.pos = l.pos // {merkle.FANOUT ** (k + 1)}")
        place = f"(l.pos // {merkle.FANOUT ** k} % {merkle.FANOUT})"
        steps.append(
            f"{{'hashed': r{k}.n > 1, 'l': array_to_string(r{k}.ds[1:{place}], ''), 'r': array_to_string(r{k}.ds[{place} + 2:], '')}}"
        )
    parts.append(f"{name}_path AS (SELECT l.*, [{', '.join(steps)}] AS steps FROM {name}0 l {' '.join(joins)})")
    return ",\n".join(parts)


def _hashed_leaf(text: str) -> str:
    fields = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP13_LEVELS = 5  # 16 ** 5 leaves of a source, and as many sources
OP13 = f"""
WITH {_CRC_TABLE},
leaves AS (
  SELECT doc_id, source, {_hashed_leaf("text")} AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0
      THEN {_hashed_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_hashed_leaf("text")} END AS found
  FROM documents, crc_table),
{_levels("t", """SELECT doc_id, found, coalesce('s' || source, '') AS tree, leaf AS digest,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves""", OP13_LEVELS)},
{_levels("u", f"SELECT tree AS name, 0 AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t{OP13_LEVELS}", OP13_LEVELS)},
paths AS (
  SELECT t.doc_id, t.digest AS leaf, t.found, u.digest AS subroot, (SELECT digest FROM u{OP13_LEVELS}) AS root, t.steps || u.steps AS steps
  FROM t_path t JOIN u_path u ON t.tree = u.name),
folded AS (
  SELECT *, list_reduce([{{'hashed': true, 'l': found, 'r': ''}}] || list_filter(steps, lambda s: s.hashed),
    lambda a, s: {{'hashed': true, 'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(list_filter(steps, lambda s: s.hashed), lambda s: s.l || s.r), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""


def statements() -> dict[str, str]:
    return {
        "op2_jaccard_join": OP2, "op5_chat_formatting": OP5, "op10_quality_rules": OP10,
        "op11_resampling": OP11, "op12_mixing": OP12, "op13_merkle_manifest": OP13,
    }
