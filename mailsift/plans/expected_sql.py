"""SQL counterparts of the registered queries, for a result check in another engine.

Written from the meaning of each operator: plain windows, plain joins, plain list functions, and
the URL pattern in its short form. Word lists, templates and patterns come from ``constants``.
"""

from __future__ import annotations

from mailsift import constants as C
from mailsift.plans.queries import BATCH_SPAN, CORPUS_LANGUAGES, TEMPLATES

SPACE = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
URL = C.PLAIN_URL


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def choose(values: list[str], index: str) -> str:
    return f"list_extract({arr(values)}, CAST({index} AS INTEGER) + 1)"


def fill(template: str, service: str, url: str, month: str) -> str:
    return (
        f"replace(replace(replace({template}, '{{service}}', {service}), '{{url}}', {url}), "
        f"'{{month}}', {month})"
    )


T, S = len(TEMPLATES), len(C.SERVICES)
LINE = fill(
    choose(TEMPLATES, f"doc_id % {T}"),
    choose(C.SERVICES, f"(doc_id // {T}) % {S}"),
    choose(C.LURE_URLS, f"(doc_id // {T * S}) % {len(C.LURE_URLS)}"),
    choose(C.MONTHS, f"(doc_id // {T * S}) % {len(C.MONTHS)}"),
)
MAILS = f"""mails AS (
  SELECT doc_id AS email_id, {LINE} || chr(10) || text AS email_text, lang AS language
  FROM documents)"""
EMAILS = f"""{MAILS}, emails AS (
  SELECT m.email_id, m.email_text, m.language, l.toxic AS label
  FROM mails m LEFT JOIN labels l ON l.doc_id = m.email_id)"""


def words(listed: list[str], low: str = "low") -> str:
    return f"list_filter({arr(listed)}, lambda w: contains({low}, w))"


SUSPICIOUS = f"list_filter(urls, lambda u: regexp_matches(u, '{C.PLAIN_ENDING}'))"


def signals(source: str) -> str:
    """CTEs up to ``scored`` over a source with ``email_id, email_text``."""
    return f"""lowered AS (SELECT *, lower(email_text) AS low FROM {source}),
found AS (
  SELECT *, {words(C.URGENCY_WORDS)} AS urgency_found, {words(C.CREDENTIAL_WORDS)} AS creds_found,
    {words(C.SALUTATION_WORDS)} AS generic_salutation,
    {words(C.ATTACHMENT_WORDS)} AS attachments_mentioned,
    regexp_extract_all(email_text, '{URL}', 1) AS urls,
    CASE WHEN regexp_matches(email_text, '(?i)from: .*@.*') THEN [{q(C.IMPERSONATION_CUE)}]
         ELSE [] END AS impersonation_cues
  FROM lowered),
suspected AS (SELECT *, {SUSPICIOUS} AS suspicious_urls FROM found),
scored AS (
  SELECT *, least(
      least(len(urgency_found), 3) * 0.2::DOUBLE + least(len(creds_found), 3) * 0.25::DOUBLE
      + least(len(attachments_mentioned), 2) * 0.15::DOUBLE
      + least(len(suspicious_urls), 3) * 0.25::DOUBLE, 0.99::DOUBLE) AS heuristic_score
  FROM suspected)"""


SCORED = f"WITH {MAILS}, {signals('mails')}"
LABELLED = f"""{SCORED}, judged AS (
  SELECT s.email_id, s.language, s.heuristic_score AS raw_score, l.toxic AS label
  FROM scored s JOIN labels l ON l.doc_id = s.email_id)"""
LABELLED_WITH_GAPS = LABELLED.replace(
    "s.heuristic_score AS raw_score", "CASE WHEN s.email_id % 17 <> 0 THEN s.heuristic_score END AS raw_score"
)
HEADED = f"""{MAILS}, headed AS (
  SELECT email_id, CASE email_id % 3 WHEN 0 THEN 'From: ' || language || '@example.org' || chr(10)
    WHEN 1 THEN 'FROM: nobody' || chr(10) ELSE '' END || email_text AS email_text
  FROM mails)"""
GAPS = f"""{EMAILS}, gaps AS (
  SELECT email_id, CASE WHEN email_id % 11 <> 0 THEN email_text END AS email_text,
    CASE WHEN email_id % 13 <> 0 THEN language END AS language, label
  FROM emails)"""
REQUESTS = f"""{MAILS}, placed AS (
  SELECT *, (email_id // {BATCH_SPAN}) * 4 + CASE WHEN email_id % {BATCH_SPAN} < 1 THEN 0
    WHEN email_id % {BATCH_SPAN} < 102 THEN 1 ELSE 2 END AS batch_id FROM mails),
requests AS (
  SELECT batch_id, list(email_text ORDER BY email_id) AS emails FROM placed GROUP BY batch_id
  UNION ALL SELECT DISTINCT (doc_id // {BATCH_SPAN}) * 4 + 3, CAST([] AS VARCHAR[])
  FROM documents),
checked AS (
  SELECT *, CASE WHEN len(emails) = 0 THEN 'EMPTY_BATCH'
    WHEN len(emails) > 100 THEN 'BATCH_TOO_LARGE' END AS reason FROM requests)"""
SPLIT = f"""{MAILS}, labelled AS (
  SELECT m.email_id, l.toxic AS label FROM mails m JOIN labels l ON l.doc_id = m.email_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label
      ORDER BY md5('42:' || email_id::VARCHAR), email_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM labelled),
cut AS (SELECT *, floor(n * 0.7::DOUBLE) AS n_train FROM ranked),
divided AS (
  SELECT email_id, label, CASE WHEN rn <= n_train THEN 'train'
    WHEN rn <= n_train + floor((n - n_train) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM cut)"""


def stable(expression: str) -> str:
    return f"CAST('0x' || substr(md5({expression}), 1, 8) AS BIGINT)"


def id_list(vocab: int, after: str = "") -> str:
    tokens = (
        f"list_slice(list_filter(string_split_regex(email_text, '[{SPACE}]+'), "
        "lambda t: t <> ''), 1, 256)"
    )
    hashed = f"list_transform({tokens}, lambda t: {stable('t')} % {vocab}{after})"
    return f"list_resize({hashed}, 256, 0)"


def made(language: str, label: str, key: str) -> str:
    def texts(table: dict[str, list[str]], index: str) -> str:
        cases = " ".join(
            f"WHEN {q(code)} THEN {choose(values, index)}"
            for code, values in table.items()
            if code != "en"
        )
        return f"CASE {language} {cases} ELSE {choose(table['en'], index)} END"

    def draw(slot: str, size: int) -> str:
        return f"{stable(f'{key} || {q(chr(58) + slot)}')} % {size}"

    template = (
        f"CASE WHEN {label} = 1 THEN {texts(C.PHISHING_TEMPLATES, draw('template', 8))} "
        f"ELSE {texts(C.LEGITIMATE_TEMPLATES, draw('template', 8))} END"
    )
    return fill(
        template,
        choose(C.SERVICES, draw("service", len(C.SERVICES))),
        choose(C.LURE_URLS, draw("url", len(C.LURE_URLS))),
        choose(C.MONTHS, draw("month", len(C.MONTHS))),
    )


GENERATED = f"""wanted AS (
  SELECT doc_id AS email_id, {choose(CORPUS_LANGUAGES, 'doc_id % 5')} AS language,
    CAST(doc_id % 2 AS INTEGER) AS label FROM documents),
generated AS (
  SELECT *, {made('language', 'label', "('42:' || email_id::VARCHAR)")} AS email_text
  FROM wanted)"""


def expansion() -> str:
    parts = []
    for label, table in ((1, C.PHISHING_TEMPLATES), (0, C.LEGITIMATE_TEMPLATES)):
        for language, texts in table.items():
            rows = ", ".join(f"({q(t)})" for t in texts)
            filled = fill("t", "s", "f", "f")
            parts.append(
                f"SELECT DISTINCT {filled} AS email_text, {q(language)} AS language, "
                f"CAST({label} AS INTEGER) AS label FROM (VALUES {rows}) AS v(t), "
                f"(SELECT unnest({arr(C.SERVICES)}) AS s), "
                f"(SELECT unnest({arr(C.LURE_URLS if label else C.MONTHS)}) AS f)"
            )
    return " UNION ALL ".join(parts)


def confusion(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}CAST(count(raw_score) AS BIGINT) AS n_rows,
  count(*) FILTER (raw_score > 0.5 AND label = 1) AS tp,
  count(*) FILTER (raw_score > 0.5 AND label <> 1) AS fp,
  count(*) FILTER (raw_score <= 0.5 AND label = 1) AS fn,
  count(*) FILTER (raw_score <= 0.5 AND label <> 1) AS tn,
  count(*) FILTER (raw_score IS NULL) AS n_unscored
FROM judged {group}"""


RATES = """n_rows, n_unscored, coalesce((tp + tn)::DOUBLE / nullif(n_rows, 0), 0) AS accuracy,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall"""
F1 = "coalesce(2.0::DOUBLE * precision * recall / nullif(precision + recall, 0), 0) AS f1"


def row_digest(*columns: str) -> str:
    """Digest of the named fields, which come in the order of their names."""

    def field(name: str) -> str:
        text = f"CAST({name} AS VARCHAR)"
        return (
            f"CASE WHEN {name} IS NOT NULL THEN '{len(name)}:{name}' || strlen({text}) || ':' || {text} ELSE '' END"
        )

    return f"sha256({' || '.join(map(field, columns))})"


def obfuscated(column: str, key: str, source: str, keep: str) -> str:
    link = "substr(u, 1, 1) || translate(substr(u, 2), 'ao', '@0')"
    return f"""pieces AS (
  SELECT *, string_split_regex({column}, '{URL}') AS gaps,
    list_transform(regexp_extract_all({column}, '{URL}', 1), lambda u: {link}) AS links
  FROM {source}),
woven AS (
  SELECT *, list_aggregate(list_transform(list_zip(gaps, links),
      lambda z: z[1] || coalesce(z[2], '')), 'string_agg', '') AS after FROM pieces)
SELECT {key}, after AS email_text{keep}, 'url' AS aug FROM woven WHERE after <> {column}"""


def synonyms(column: str) -> str:
    out = column
    for word, synonym in C.SYNONYMS:
        out = rf"regexp_replace({out}, '(?i)\b{word}\b', {q(synonym)}, 'g')"
    return out


def statements() -> dict[str, str]:
    """SQL by query name. Queries that depend on a fitted model have none."""
    joined = ", ".join(
        f"array_to_string({c}, '|') AS {c}"
        for c in (
            "urgency_found", "creds_found", "generic_salutation", "attachments_mentioned",
            "urls", "suspicious_urls", "impersonation_cues",
        )
    )
    found: dict[str, str] = {}
    found["emails_view"] = (
        f"WITH {EMAILS} SELECT email_id, email_text, language, label FROM emails"
    )
    found["csv_round_trip"] = found["emails_view"]
    found["stored_append"] = found["emails_view"]
    found["keyword_hits"] = f"""{SCORED} SELECT email_id,
  array_to_string(urgency_found, '|') AS urgency, array_to_string(creds_found, '|') AS credentials,
  array_to_string(generic_salutation, '|') AS salutation,
  array_to_string(attachments_mentioned, '|') AS attachments FROM scored"""
    found["extract_urls"] = f"""WITH {MAILS} SELECT email_id,
  array_to_string(regexp_extract_all(email_text, '{URL}', 1), '|') AS urls,
  CAST(len(regexp_extract_all(email_text, '{URL}', 1)) AS INTEGER) AS n_urls FROM mails"""
    found["page_urls"] = f"""SELECT page_id,
  array_to_string(regexp_extract_all(html, '{URL}', 1), '|') AS urls,
  CAST(len(regexp_extract_all(html, '{URL}', 1)) AS INTEGER) AS n_urls FROM pages"""
    found["suspicious_urls"] = f"""{SCORED} SELECT email_id,
  array_to_string(suspicious_urls, '|') AS suspicious,
  CAST(len(suspicious_urls) AS INTEGER) AS n_suspicious FROM scored"""
    found["impersonation_cue"] = f"""WITH {HEADED}, {signals('headed')}
SELECT email_id, array_to_string(impersonation_cues, '|') AS cues FROM scored"""
    found["heuristic_score"] = f"{SCORED} SELECT email_id, heuristic_score FROM scored"
    found["social_signals"] = f"""WITH {HEADED}, {signals('headed')}
SELECT email_id, {joined}, heuristic_score FROM scored"""
    found["verdict_by_language"] = f"""{SCORED} SELECT language, count(*) AS n_emails,
  count(*) FILTER (heuristic_score > 0.4) AS n_risky,
  round(avg(heuristic_score), 9) AS mean_score FROM scored GROUP BY language"""
    found["recommendation"] = f"""{SCORED}, v AS (
  SELECT email_id, heuristic_score > 0.5 OR heuristic_score > 0.4 AS is_risky FROM scored)
SELECT email_id, is_risky,
  CASE WHEN is_risky THEN {q(C.RISKY_HEADLINE)} ELSE {q(C.SAFE_HEADLINE)} END AS recommendation,
  CASE WHEN is_risky THEN {q(C.RISKY_STEPS)} ELSE {q(C.SAFE_STEPS)} END AS next_steps FROM v"""

    found["profile_nulls"] = f"""WITH {GAPS}
SELECT count(*) FILTER (email_text IS NULL) AS null_email_text,
  count(*) FILTER (language IS NULL) AS null_language,
  count(*) FILTER (label IS NULL) AS null_label FROM gaps"""
    found["class_counts"] = f"""WITH {EMAILS} SELECT label, count(*) AS n_rows FROM emails
WHERE label IS NOT NULL GROUP BY label"""
    found["class_slices"] = f"""WITH {EMAILS} SELECT count(*) FILTER (label = 1) AS n_phishing,
  count(*) FILTER (label = 0) AS n_legitimate FROM emails"""
    found["language_counts"] = f"""WITH {GAPS} SELECT language, count(*) AS n_rows FROM gaps
WHERE language IS NOT NULL GROUP BY language"""
    for name, value in (
        ("text_length_stats", "coalesce(email_text, 'nan')"),
        ("text_length_stats_strict", "email_text"),
    ):
        found[name] = f"""WITH {GAPS} SELECT avg(length({value})) AS text_len_mean,
  CAST(max(length({value})) AS INTEGER) AS text_len_max,
  CAST(min(length({value})) AS INTEGER) AS text_len_min FROM gaps"""
    found["dataset_valid"] = f"""WITH {EMAILS}, twin AS (
  SELECT 'all' AS part, label FROM emails
  UNION ALL SELECT 'labelled', label FROM emails WHERE label IS NOT NULL),
v AS (SELECT part, count(*) AS n_rows, bool_and(coalesce(label IN (0, 1), false)) AS ok
  FROM twin GROUP BY part)
SELECT part, n_rows, ok AS all_labels_valid, ok AND n_rows > 10 AS is_valid FROM v"""
    found["validation_report"] = f"""WITH {GAPS}, t AS (
  SELECT count(*) AS n, count(*) FILTER (email_text IS NULL) AS a,
    count(*) FILTER (language IS NULL) AS b, count(*) FILTER (label IS NULL) AS c,
    max(length(coalesce(email_text, 'nan'))) AS hi, min(length(coalesce(email_text, 'nan'))) AS lo,
    bool_and(coalesce(label IN (0, 1), false)) AND count(*) > 10 AS ok FROM gaps)
SELECT 'missing_values' AS section, 'email_text' AS key, a::VARCHAR AS value FROM t
UNION ALL SELECT 'missing_values', 'language', b::VARCHAR FROM t
UNION ALL SELECT 'missing_values', 'label', c::VARCHAR FROM t
UNION ALL SELECT 'text_len', 'max', hi::VARCHAR FROM t
UNION ALL SELECT 'text_len', 'min', lo::VARCHAR FROM t
UNION ALL SELECT 'rows', 'total', n::VARCHAR FROM t
UNION ALL SELECT 'valid', '', ok::VARCHAR FROM t
UNION ALL SELECT 'error', '', 'Invalid labels or too few rows' FROM t WHERE NOT ok
UNION ALL SELECT 'class_counts', label::VARCHAR, count(*)::VARCHAR FROM gaps
  WHERE label IS NOT NULL GROUP BY label
UNION ALL SELECT 'language_counts', language, count(*)::VARCHAR FROM gaps
  WHERE language IS NOT NULL GROUP BY language"""
    found["reject_blank"] = f"""WITH {MAILS}, blanked AS (
  SELECT email_id, CASE email_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(9) || chr(12288) ||
    chr(10) WHEN 2 THEN NULL ELSE email_text END AS t FROM mails)
SELECT email_id, CASE WHEN t IS NULL OR regexp_full_match(t, '[{SPACE}]*') THEN 'EMPTY_TEXT' END
  AS reason FROM blanked"""
    found["guard_batches"] = f"""WITH {REQUESTS}
SELECT batch_id, CAST(len(emails) AS INTEGER) AS n_emails, reason FROM checked"""
    found["text_preview"] = f"""WITH {MAILS}
SELECT email_id, substr(email_text, 1, 60) || '...' AS preview FROM mails"""

    found["classify"] = f"""{SCORED} SELECT email_id, heuristic_score AS raw_score,
  CASE WHEN heuristic_score > 0.5 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS label,
  CASE WHEN heuristic_score > 0.5 THEN heuristic_score ELSE 1.0 - heuristic_score END
    AS confidence, heuristic_score > 0.5 AS is_phishing FROM scored"""
    both = []
    for mode, cut in (("compat", "0.5"), ("strict", "0.9")):
        both.append(f"""SELECT email_id, heuristic_score AS raw_score,
  CASE WHEN heuristic_score > {cut} THEN 'PHISHING' ELSE 'LEGITIMATE' END AS label,
  CASE WHEN heuristic_score > 0.9 THEN heuristic_score ELSE 1.0 - heuristic_score END
    AS confidence, 0.9::DOUBLE AS threshold, heuristic_score > {cut} AS is_phishing,
  '{mode}' AS mode FROM scored""")
    found["confidence_threshold"] = f"{SCORED} {both[0]} UNION ALL {both[1]}"
    found["assign_ids"] = f"""WITH bare AS (
  SELECT text, lang, unnest(range(doc_id % 3 + 1)) AS copy FROM documents),
d AS (SELECT text, lang, {row_digest("lang", "text")} AS h FROM bare)
SELECT h || '-' || row_number() OVER (PARTITION BY h) AS email_id, lang, length(text) AS n_chars FROM d"""
    digest = row_digest("email_text", "label", "language")
    found["append_with_ids"] = f"""WITH {EMAILS}, both_appends AS (
  SELECT email_text, language, label, unnest(range(email_id % 3 + 1)) AS copy FROM emails
  UNION ALL SELECT email_text, language, label, 0 FROM emails),
d AS (SELECT *, {digest} AS h FROM both_appends)
SELECT h || '-' || row_number() OVER (PARTITION BY h) AS email_id, language, label, length(email_text) AS n_chars FROM d"""
    with_source = row_digest("email_text", "label", "language", "source_id")
    found["snapshot_as_of"] = f"""WITH {EMAILS}, d AS (
  SELECT email_id AS source_id, email_text, language, label FROM emails),
named AS (SELECT *, {with_source} || '-1' AS email_id FROM d)
SELECT version, email_id, source_id, language, label, length(email_text) AS n_chars
FROM named JOIN (SELECT CAST(unnest([1, 2]) AS INTEGER) AS version) v ON label IS NOT NULL OR version = 2"""
    found["table_versions"] = """WITH n AS (
  SELECT count(l.toxic) AS labelled, count(*) AS everything FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CAST(1 AS BIGINT) AS version, 'append 0' AS append_id, labelled AS n_rows, labelled AS listed_rows, 0::BIGINT AS n_damaged FROM n
UNION ALL SELECT 2, 'append 1', everything - labelled, everything, 0 FROM n"""
    found["read_snapshot"] = f"WITH {EMAILS} SELECT * FROM emails WHERE label IS NOT NULL"
    found["stored_append_ids"] = f"""WITH {EMAILS}
SELECT label IS NULL AS appended, count(*) AS n_rows, count(*) AS n_ids,
  CASE WHEN label IS NULL THEN 1 ELSE min(email_id) END AS first_id,
  CASE WHEN label IS NULL THEN count(*) ELSE max(email_id) END AS last_id,
  CAST(sum(length(email_text)) AS BIGINT) AS n_chars
FROM emails GROUP BY label IS NULL"""
    found["csv_by_header"] = f"""WITH {EMAILS}, marked AS (
  SELECT *, email_id % 6 = 0 AS bad FROM emails)
SELECT email_id, language, CASE WHEN NOT bad THEN label END AS label,
  CASE WHEN bad OR label IS NOT NULL THEN 'b' END AS origin,
  CASE WHEN bad THEN 'quarantine' ELSE 'good' END AS status,
  CASE WHEN bad THEN 'label is no number' END AS reason, length(email_text) AS n_chars,
  CASE WHEN bad THEN true END AS row_kept FROM marked"""
    found["retrain_latest"] = f"""WITH {EMAILS}, d AS (
  SELECT language, label, {digest} AS h FROM emails WHERE label IS NOT NULL),
named AS (SELECT *, h || '-' || row_number() OVER (PARTITION BY h) AS id FROM d),
ranked AS (
  SELECT language, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM named),
cut AS (SELECT *, floor(n * 0.7::DOUBLE) AS n_train FROM ranked),
test AS (SELECT language FROM cut WHERE rn > n_train + floor((n - n_train) * 0.5::DOUBLE))
SELECT CAST(2 AS BIGINT) AS version, 'language' AS scope, language, count(*) AS n_rows FROM test GROUP BY language
UNION ALL SELECT 2, 'overall', NULL, count(*) FROM test"""
    found["column_check"] = f"""SELECT column_name, source = 'labelled' AS present, source
FROM (SELECT unnest({arr(C.REQUIRED_COLUMNS)}) AS column_name), (SELECT unnest(['labelled', 'pages']) AS source)"""
    found["display_scores"] = f"""{SCORED} SELECT email_id,
  greatest(least(heuristic_score * 1.5::DOUBLE - 0.25::DOUBLE, 1.0), 0.0) AS clamped,
  printf('%.3f', heuristic_score) AS score_3, printf('%.4f', heuristic_score) AS score_4,
  printf('%.1f%%', heuristic_score * 100.0::DOUBLE) AS percent FROM scored"""

    found["stratified_split"] = f"WITH {SPLIT} SELECT * FROM divided"
    copies = """copies AS (
  SELECT d.doc_id AS email_id, d.text AS email_text, l.toxic AS label, unnest(range(d.doc_id % 3 + 1)) AS n
  FROM documents d JOIN labels l USING (doc_id)),
rows AS (SELECT email_id, label, CAST(n AS INTEGER) AS copy, coalesce(sha256(email_text), 'null') AS digest FROM copies)"""
    grouped = f"""{copies},
counts AS (SELECT digest, label, count(*) AS n FROM rows GROUP BY ALL),
groups AS (
  SELECT digest, sum(n) AS weight, first(label ORDER BY n DESC, label NULLS LAST) AS class FROM counts GROUP BY digest),
placed AS (
  SELECT digest, coalesce(sum(weight) OVER (PARTITION BY class ORDER BY md5('42:' || digest)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (PARTITION BY class) AS n FROM groups),
cut AS (SELECT *, floor(n * 0.7::DOUBLE) AS n_train FROM placed),
split_of AS (
  SELECT digest, CASE WHEN before < n_train THEN 'train'
    WHEN before < n_train + floor((n - n_train) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM cut),
by_text AS (SELECT rows.*, split FROM rows JOIN split_of USING (digest))"""
    found["grouped_split"] = f"WITH {grouped} SELECT email_id, copy, label, split FROM by_text"
    leaked = """SELECT digest, count(*) AS n, min(split) <> max(split) AS leaked FROM {0} GROUP BY digest"""
    counted = "count(*) AS n_texts, count(*) FILTER (leaked) AS n_leaked, CAST(coalesce(sum(n) FILTER (leaked), 0) AS BIGINT) AS n_rows"
    found["split_leakage"] = f"""WITH {grouped},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || email_id || '-' || copy)) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM rows),
cut_rows AS (SELECT *, floor(n * 0.7::DOUBLE) AS n_train FROM ranked),
by_row AS (
  SELECT digest, CASE WHEN rn <= n_train THEN 'train'
    WHEN rn <= n_train + floor((n - n_train) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM cut_rows)
SELECT 'row' AS cut_by, {counted} FROM ({leaked.format("by_row")})
UNION ALL SELECT 'text', {counted} FROM ({leaked.format("by_text")})"""
    found["split_sizes"] = (
        f"WITH {SPLIT} SELECT split, count(*) AS n_rows FROM divided GROUP BY split"
    )
    position = "row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id)"
    found["shuffle_order"] = f"SELECT doc_id AS email_id, {position} AS position FROM documents"
    found["batch_rows"] = f"""SELECT doc_id AS email_id, ({position} - 1) // 32 AS batch_id,
  ({position} - 1) % 32 AS batch_pos FROM documents"""
    found["batch_rows_in_order"] = """SELECT doc_id AS email_id,
  (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id,
  (row_number() OVER (ORDER BY doc_id) - 1) % 32 AS batch_pos FROM documents"""
    found["append_emails"] = f"""WITH {EMAILS} SELECT *, CAST(NULL AS VARCHAR) AS origin
FROM emails WHERE label IS NOT NULL
UNION ALL SELECT *, 'added' FROM emails WHERE label IS NULL"""
    found["append_single"] = f"""WITH {EMAILS} SELECT * FROM emails WHERE label IS NOT NULL
UNION ALL SELECT NULL, 'Please confirm your login', 'en', 1"""
    found["preview_new_rows"] = f"""WITH {EMAILS} SELECT * FROM emails WHERE label IS NULL
ORDER BY email_id LIMIT 10"""

    found["token_ids"] = f"""WITH {MAILS}
SELECT email_id, array_to_string({id_list(C.VOCAB_SIZE)}, ',') AS ids FROM mails"""
    found["fold_ids"] = f"""WITH {MAILS}
SELECT email_id, array_to_string({id_list(50_000, f' % {C.VOCAB_SIZE}')}, ',') AS ids
FROM mails"""
    found["padding_mask"] = f"""WITH {MAILS} SELECT email_id, array_to_string(
  list_transform({id_list(C.VOCAB_SIZE)}, lambda i: CASE WHEN i <> 0 THEN 1 ELSE 0 END), '')
  AS mask FROM mails"""
    found["batch_explode"] = f"""WITH {REQUESTS} SELECT batch_id,
  CAST(unnest(range(len(emails))) AS INTEGER) AS pos, unnest(emails) AS email_text
FROM checked WHERE reason IS NULL"""
    found["label_cast"] = """SELECT d.doc_id AS email_id, CASE WHEN d.doc_id % 4 <> 0 THEN l.toxic END AS label,
  CASE WHEN d.doc_id % 4 = 0 THEN 'spam' END AS refused
FROM documents d LEFT JOIN labels l USING (doc_id)"""
    count = f"len(regexp_extract_all(email_text, '[^{SPACE}]+'))"
    found["token_length_histogram"] = f"""WITH {MAILS}, c AS (
  SELECT language, {count} AS n FROM mails)
SELECT language, n // 32 AS bin, count(*) AS n_rows, count(*) FILTER (n > 256) AS n_truncated
FROM c GROUP BY ALL"""
    found["token_length_summary"] = f"""WITH {MAILS}, c AS (
  SELECT language, {count} AS n FROM mails)
SELECT language, count(*) AS n_rows, quantile_cont(n::DOUBLE, 0.5) AS tokens_p50,
  quantile_cont(n::DOUBLE, 0.95) AS tokens_p95,
  (count(*) FILTER (n > 256))::DOUBLE / count(*) AS share_truncated FROM c GROUP BY language"""

    found["expand_templates"] = f"""WITH {MAILS}, expanded AS ({expansion()}),
firsts AS (SELECT split_part(email_text, chr(10), 1) AS line, count(*) AS n FROM mails GROUP BY 1)
SELECT e.email_text, e.language, e.label, coalesce(f.n, 0) AS n_emails
FROM expanded e LEFT JOIN firsts f ON f.line = e.email_text"""
    found["generate_emails"] = f"WITH {GENERATED} SELECT * FROM generated"
    def share(letter: str) -> str:
        return rf"len(regexp_extract_all(email_text, '\p{{{letter}}}'))"

    def stop(listed: list[str]) -> str:
        return (
            r"len(list_filter(string_split_regex(lower(email_text), '[^\p{L}]+'), "
            f"lambda w: list_contains({arr(listed)}, w)))"
        )

    found["detect_language"] = f"""WITH {GENERATED}, c AS (
  SELECT email_id, {share('L')} AS letters, {share('Han')} AS han, {share('Cyrillic')} AS cyr,
    {stop(C.SWAHILI_STOPWORDS)} AS sw, {stop(C.ENGLISH_STOPWORDS)} AS en FROM generated)
SELECT email_id, CASE WHEN han * 5 >= letters AND han > 0 AND han >= cyr THEN 'zh'
  WHEN cyr * 5 >= letters AND cyr > 0 THEN 'ru' WHEN sw > en THEN 'sw' ELSE 'en' END AS detected
FROM c"""
    text = made("language", "label", "('42:' || email_id::VARCHAR)")
    found["sample_corpus"] = f"""WITH half AS (
  SELECT count(*) // 4 // 2 AS h FROM documents),
ranked AS (SELECT doc_id AS email_id, {position} - 1 AS rank FROM documents),
numbered AS (
  SELECT email_id, CASE WHEN rank < 8 * h THEN rank ELSE (rank - 8 * h) * greatest(h, 1) END AS n, greatest(h, 1) AS g
  FROM ranked, half),
cells AS (
  SELECT email_id, {choose(C.LANGUAGES, 'n // (g * 2)')} AS language,
    CAST(CASE WHEN (n // g) % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM numbered)
SELECT email_id, {text} AS email_text, language, label FROM cells"""

    found["class_metrics"] = f"""{LABELLED_WITH_GAPS}, c AS ({confusion('')}), r AS (SELECT {RATES} FROM c)
SELECT *, {F1} FROM r"""
    found["log_loss"] = f"""{LABELLED_WITH_GAPS}, p AS (
  SELECT label, CASE WHEN raw_score IS NOT NULL THEN greatest(least(raw_score, 1 - 1e-7), 1e-7) END AS p
  FROM judged)
SELECT round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 9) AS log_loss,
  count(*) FILTER (p IS NULL) AS n_unscored FROM p"""
    found["metrics_by_language"] = f"""{LABELLED_WITH_GAPS}, c AS (
  {confusion('language')} UNION ALL SELECT NULL, * FROM ({confusion('')})),
r AS (SELECT language, {RATES} FROM c)
SELECT *, {F1}, CASE WHEN language IS NULL THEN 'overall' ELSE 'language' END AS scope FROM r"""
    found["confusion_by_language"] = f"""{LABELLED_WITH_GAPS}
SELECT language, tp, fp, fn, tn, n_unscored FROM ({confusion('language')})"""
    found["roc_by_language"] = f"""{LABELLED}, spread AS (
  SELECT j.language, j.label, j.raw_score * 0.9::DOUBLE +
    (d.n_chars % 1000)::DOUBLE / 10000.0::DOUBLE AS score
  FROM judged j JOIN documents d ON d.doc_id = j.email_id),
steps AS (SELECT language, score, count(*) FILTER (label = 1) AS pos,
  count(*) FILTER (label <> 1) AS neg FROM spread GROUP BY ALL),
summed AS (SELECT language, score,
  sum(pos) OVER (PARTITION BY language ORDER BY score DESC) AS cp,
  sum(neg) OVER (PARTITION BY language ORDER BY score DESC) AS cn,
  sum(pos) OVER (PARTITION BY language) AS tp, sum(neg) OVER (PARTITION BY language) AS tn
  FROM steps)
SELECT language, score, coalesce(cp::DOUBLE / nullif(tp, 0), 0) AS tpr,
  coalesce(cn::DOUBLE / nullif(tn, 0), 0) AS fpr FROM summed"""
    found["class_weights"] = """WITH c AS (
  SELECT toxic AS label, count(*) AS n_class FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)
SELECT label, n_class, (sum(n_class) OVER ())::DOUBLE / (count(*) OVER () * n_class) AS weight
FROM c"""
    found["latency_summary"] = """SELECT event_type, count(*) AS n_rows,
  round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"""

    label = "CASE WHEN heuristic_score > 0.5 THEN 'PHISHING' ELSE 'LEGITIMATE' END"
    void = {
        "label": f"CASE WHEN email_id % 5 <> 0 THEN {label} END",
        "raw_score": "CASE WHEN email_id % 5 <> 0 THEN heuristic_score END",
        "status": "CASE WHEN email_id % 5 <> 0 THEN 'OK' ELSE 'EMPTY_TEXT' END",
        "text_len": "CAST(CASE WHEN email_id % 5 <> 0 THEN length(email_text) ELSE 1 + email_id % 7 END AS INTEGER)",
    }
    logged = ", ".join(f"{value} AS {name}" for name, value in void.items())
    found["score_job"] = f"""{SCORED} SELECT email_id, {logged}, 0::BIGINT AS batch_id FROM scored"""
    scored_only = {
        "confidence": "CASE WHEN heuristic_score > 0.5 THEN heuristic_score ELSE 1.0 - heuristic_score END",
        "threshold": "0.5::DOUBLE",
        "is_phishing": "heuristic_score > 0.5",
    }
    from_score = ", ".join(f"CASE WHEN email_id % 5 <> 0 THEN {v} END AS {k}" for k, v in scored_only.items())
    found["score_job_results"] = f"""{SCORED} SELECT email_id, language, {logged}, {from_score}, 0 AS batch FROM scored"""
    found["score_batches"] = f"""WITH {REQUESTS}, flat AS (
  SELECT batch_id, CAST(unnest(range(len(emails))) AS INTEGER) AS pos,
    unnest(emails) AS email_text FROM checked WHERE reason IS NULL),
{signals('flat')}
SELECT batch_id, pos, heuristic_score AS raw_score, {label} AS label,
  CASE WHEN heuristic_score > 0.5 THEN heuristic_score ELSE 1.0 - heuristic_score END
    AS confidence, 0.5::DOUBLE AS threshold, heuristic_score > 0.5 AS is_phishing FROM scored"""
    found["stream_score"] = f"""{SCORED} SELECT email_id, language, {void['text_len']} AS text_len,
  CASE WHEN email_id % 5 <> 0 THEN heuristic_score END AS heuristic_score,
  CASE WHEN email_id % 5 <> 0 THEN heuristic_score > 0.4 END AS is_risky, {void['status']} AS status FROM scored"""
    found["stream_audit"] = f"""{SCORED} SELECT email_id, {logged} FROM scored"""
    found["monitor_windows"] = """WITH w AS (
  SELECT date_trunc('hour', ts) AS s, count(*) AS n_rows,
    avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS e,
    avg(value) AS m FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, n_rows,
  round(e, 9) AS error_share, round(m, 6) AS mean_value FROM w"""

    found["monitor_percentiles"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) AS n_rows, true AS p50, true AS p95, true AS p99 FROM events GROUP BY date_trunc('hour', ts)"""
    found["report_file"] = found["validation_report"] + f"""
UNION ALL SELECT 'text_len', 'mean', round(avg(length(coalesce(email_text, 'nan'))), 6)::VARCHAR FROM gaps"""
    found["raw_text_files"] = f"""WITH {MAILS}
SELECT coalesce(language, 'none') AS language, CAST(sum(length(email_text) + 1) AS BIGINT) AS n_chars,
  CAST(sum(1 + length(email_text) - length(replace(email_text, chr(10), ''))) AS BIGINT) AS n_lines
FROM mails WHERE email_text IS NOT NULL GROUP BY 1"""
    found["corpus_file"] = f"""WITH n AS (SELECT count(*) // 4 // 2 AS half FROM documents)
SELECT language, label, half AS n_rows, half AS n_ids
FROM n, (SELECT unnest({arr(C.LANGUAGES)}) AS language), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS label)"""

    listed = {
        name: f"len(list_filter(ws, lambda w: list_contains({arr(values)}, w)))"
        for name, values in (("sw", C.SWAHILI_STOPWORDS), ("en", C.ENGLISH_STOPWORDS))
    }
    found["detect_mail_language"] = f"""WITH {MAILS}, c AS (
  SELECT email_id, email_text, len(regexp_extract_all(email_text, '\\p{{L}}')) AS letters,
    len(regexp_extract_all(email_text, '\\p{{Han}}')) AS han,
    len(regexp_extract_all(email_text, '\\p{{Cyrillic}}')) AS cyrillic,
    string_split_regex(lower(email_text), '[^\\p{{L}}]+') AS ws FROM mails)
SELECT email_id, CASE WHEN email_text IS NULL OR regexp_full_match(email_text, '[{SPACE}]*') THEN NULL
  WHEN han * 5 >= letters AND han > 0 AND han >= cyrillic THEN 'zh'
  WHEN cyrillic * 5 >= letters AND cyrillic > 0 THEN 'ru'
  WHEN {listed["sw"]} > {listed["en"]} THEN 'sw' ELSE 'en' END AS guess FROM c"""

    found["document_frequencies"] = f"""WITH {MAILS}, t AS (
  SELECT DISTINCT email_id, unnest(list_transform(list_filter(string_split_regex(email_text, '[{SPACE}]+'),
    lambda t: t <> ''), lambda t: {stable('t')} % {C.VOCAB_SIZE})) AS term_id FROM mails)
SELECT CAST(term_id AS INTEGER) AS term_id, count(*) AS n_docs,
  round(ln(((SELECT count(*) FROM mails) + 1)::DOUBLE / (count(*) + 1)::DOUBLE), 9) AS idf FROM t GROUP BY term_id"""
    found["augment_urls"] = (
        f"WITH {MAILS}, {obfuscated('email_text', 'email_id', 'mails', ', language')}"
    )
    found["augment_page_urls"] = f"WITH {obfuscated('html', 'page_id', 'pages', '')}"
    changes = {
        "synonym": synonyms("email_text"),
        "digit": "translate(email_text, '0', 'O')",
    }
    for method, name in (("synonym", "augment_synonyms"), ("digit", "augment_digits")):
        found[name] = f"""WITH {MAILS}, c AS (
  SELECT email_id, language, email_text AS t, {changes[method]} AS after FROM mails)
SELECT email_id, after AS email_text, language, '{method}' AS aug FROM c WHERE after <> t"""
    found["augment_all"] = f"""WITH {MAILS}
SELECT 'none' AS aug, count(*) AS n_rows FROM mails
UNION ALL SELECT 'synonym', count(*) FROM mails WHERE {changes['synonym']} <> email_text
UNION ALL SELECT 'digit', count(*) FROM mails WHERE {changes['digit']} <> email_text
UNION ALL SELECT 'url', count(*) FROM ({found['augment_urls']})"""
    return found
