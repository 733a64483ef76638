"""The driver queries restated in SQL, without any of the operators."""

from __future__ import annotations

# Whitespace and word characters for RE2, whose classes are ASCII.
_WS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WORD = r"[\p{L}\p{N}_]{2,}"
_URL = rf"(?i)https?://[^{_WS}<>\"'']+"

_MESSAGES = """
messages AS (
  SELECT 'doc_' || d.doc_id AS id, d.text,
         CASE WHEN d.n_chars < 500 THEN 'sms' ELSE 'email' END AS channel,
         l.toxic AS label, d.source, d.lang, d.doc_id
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_ALL = """
messages AS (
  SELECT 'doc_' || doc_id AS id, text, CASE WHEN n_chars < 500 THEN 'sms' ELSE 'email' END AS channel,
         source, lang, doc_id
  FROM documents)"""
_SCORED = """
scored AS (
  SELECT 'doc_' || d.doc_id AS id,
         CASE WHEN d.n_chars < 500 THEN 'sms' ELSE 'email' END AS channel,
         l.toxic AS label, d.source,
         ((d.doc_id * 7919 + l.toxic * 350) % 1000) / 1000::DOUBLE AS prob_phish, d.doc_id
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_TURNS = """
turns AS (
  SELECT 'turn_' || conv_id || '_' || turn AS id, text, 'sms' AS channel,
         (role = 'assistant')::INT AS label, 'src' || (conv_id % 5) AS source, 'en' AS lang,
         conv_id, turn
  FROM conversations)"""


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[{_WS}]+', ' ', 'g'))"


def _hits(c: str, terms: tuple[str, ...]) -> str:
    return " + ".join(f"contains({c}, '{t}')::INT" for t in terms)


def _count(pattern: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


_MOBILE = rf"(\+?64[{_WS}]?|0)2[0-9]([{_WS}\-]?\p{{Nd}}){{6,8}}"
_LANDLINE = rf"(\+?64[{_WS}]?|0)[34679]([{_WS}\-]?\p{{Nd}}){{7}}"
_MONEY = rf"(?i)(NZ\$|NZD[{_WS}]?\$?|\$NZ)[{_WS}]?\p{{Nd}}+([.,]\p{{Nd}}+)?"
_CYRILLIC = "аеіорсухӏАЕІОРСУХӀ"

_TERM_CUES = {
    "impersonated_govt": (("tion", "anis", "ment", "ung "), True),
    "impersonated_bank": (("worth", "xless", "enter"), True),
    "impersonated_telco_utility": (("zzz", "ouel"), True),
    "te_reo_salutation": (("kia", "über", "ère"), True),
    "nz_lure_keyword_count": (("the ", "ing", "and", "eau", "lich", "token", "class"), False),
}
_CUE_WEIGHTS = {
    "impersonated_govt": 0.7, "impersonated_bank": 1.1, "nz_lure_keyword_count": -0.4,
    "nz_postcode_count": 0.2, "te_reo_salutation": 0.5,
}


def _term_cues(c: str = "lower(text)") -> str:
    out = []
    for name, (terms, flag) in _TERM_CUES.items():
        hits = _hits(c, terms)
        out.append(f"(({hits}) > 0)::INT AS {name}" if flag else f"({hits})::INT AS {name}")
    return ", ".join(out)


_PATTERN_CUES = f"""
  {_count(_MOBILE)}::INT AS nz_mobile_count,
  {_count(_LANDLINE)}::INT AS nz_landline_count,
  {_count(_MONEY)}::INT AS nzd_mention_count,
  {_count(r'\b[0-9]{4}\b')}::INT AS nz_postcode_count,
  {_count(_URL)}::INT AS url_count"""
_LAST_CUES = f"""
  {_count(f'[{_CYRILLIC}]')}::INT AS homoglyph_chars,
  contains(lower(text), 'xn--')::INT AS has_punycode"""


def _host(c: str) -> str:
    return f"rtrim(lower(regexp_extract({c}, '(?i)^https?://([^/?#]*@)?([^/?#:]+)', 2)), '.')"


def _domain(host: str, suffixes: tuple[str, ...]) -> str:
    """Last labels of the host around the longest suffix."""
    whens = [f"WHEN regexp_full_match({host}, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN {host}"]
    for suffix in sorted(suffixes, key=lambda s: -s.count(".")):
        dotted = suffix.replace(".", r"\.")
        whens.append(
            f"WHEN {host} = '{suffix}' OR ends_with({host}, '.{suffix}') "
            f"THEN regexp_extract({host}, '([^.]+\\.)?{dotted}$')"
        )
    return f"CASE {' '.join(whens)} ELSE regexp_extract({host}, '[^.]*$') END"


_SUFFIXES = (
    "com", "co", "net", "org", "xyz", "help", "nz", "co.nz", "govt.nz", "org.nz", "ac.nz", "example",
)


def _like(c: str, legitimate: str) -> str:
    root = legitimate.split(".")[0]
    return f"(contains({c}, '{root}') AND {c} <> '{legitimate}')::INT"


def _grams(table: str, key: str, longest: int = 2) -> str:
    """tf: (key, term, tf) of every n-gram."""
    pairs = ""
    if longest == 2:
        pairs = """UNION ALL SELECT key, w[i] || ' ' || w[i + 1] AS term
                   FROM words, range(1, len(w)) AS r(i)"""
    return f"""
words AS (
  SELECT {key} AS key,
         regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '{_WORD}') AS w
  FROM {table}),
grams AS (SELECT key, unnest(w) AS term FROM words {pairs}),
tf AS (SELECT key, term, count(*) AS tf FROM grams GROUP BY key, term)"""


def _vocabulary(table: str, k: int, min_df: int = 2, max_df: float = 0.95) -> str:
    return f"""
n AS (SELECT count(*) AS n FROM {table}),
vocabulary AS (
  SELECT term, df, total, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term), n
  WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n
  ORDER BY total DESC, term LIMIT {k})"""


_WEIGHTS = """
raw AS (
  SELECT tf.key, tf.term, (1 + ln(tf.tf)) * v.idf AS raw FROM tf JOIN vocabulary v USING (term)),
weights AS (
  SELECT key AS id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS weight FROM raw)"""


def _linear(columns: str = "c.id, channel") -> str:
    base = " + ".join(f"({w}) * {c}" for c, w in _CUE_WEIGHTS.items())
    hashed = "('0x' || substr(sha256('42|' || term), 1, 8))::BIGINT"
    return f"""
WITH {_ALL}, {_grams('messages', 'id')}, {_vocabulary('messages', 500)}, {_WEIGHTS},
terms AS (
  SELECT id, sum(weight * (({hashed} % 2001 - 1000) / 500::DOUBLE)) AS z FROM weights GROUP BY id),
cues AS (SELECT id, channel, doc_id, {_term_cues()}, {_PATTERN_CUES} FROM messages)
SELECT {columns},
       round(1 / (1 + exp(-(-0.25 + {base} + coalesce(z, 0)))), 6) AS prob_phish
FROM cues c LEFT JOIN terms USING (id)"""


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) = 0 THEN 0.0::DOUBLE ELSE ({top})::DOUBLE / ({bottom}) END"


def _counts(threshold: float, keep: str = "TRUE") -> str:
    p, y = f"(prob_phish >= {threshold})", "(label = 1)"
    return f"""
count(*) FILTER ({keep} AND {y} AND {p}) AS tp, count(*) FILTER ({keep} AND NOT {y} AND {p}) AS fp,
count(*) FILTER ({keep} AND {y} AND NOT {p}) AS fn, count(*) FILTER ({keep} AND NOT {y} AND NOT {p}) AS tn"""


_ACCURACY = _ratio("tp + tn", "tp + fp + fn + tn")
_PRECISION, _RECALL = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
_F1, _F0 = _ratio("2 * tp", "2 * tp + fp + fn"), _ratio("2 * tn", "2 * tn + fp + fn")
_PRESENT = "((2 * tp + fp + fn > 0)::INT + (2 * tn + fp + fn > 0)::INT)"


def _auc(rows: str, by: str) -> str:
    """Mean rank of the positives, ties at their middle rank."""
    over = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}," if by else ""
    return f"""
SELECT {head} CASE WHEN sum(label) IN (0, count(*)) THEN NULL ELSE
  (sum(rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
  / (sum(label) * (count(*) - sum(label)))::DOUBLE END AS roc_auc
FROM (SELECT *, rank() OVER ({over} ORDER BY prob_phish)
        + (count(*) OVER (PARTITION BY {by + ',' if by else ''} prob_phish) - 1) / 2.0::DOUBLE AS rank
      FROM {rows}) {group}"""


def _level(rows: str, level: int, key: str, name: str) -> str:
    auc = _auc(rows, key)
    group = f"GROUP BY {key}" if key else ""
    picked = f"{key} AS k," if key else "NULL AS k,"
    on = "ON m.k = a.k" if key else "ON TRUE"
    auc = f"SELECT {key + ' AS k,' if key else ''} roc_auc FROM ({auc})"
    where = "WHERE m.k IS NOT NULL AND tp + fn > 0 AND fp + tn > 0" if key else ""
    return f"""
SELECT {name} AS subgroup, tp + fp + fn + tn AS n, round({_ACCURACY}, 6) AS accuracy,
       round({_PRECISION}, 6) AS precision_phish, round({_RECALL}, 6) AS recall_phish,
       round({_F1}, 6) AS f1_phish, round(roc_auc, 6) AS roc_auc
FROM (SELECT {picked} {_counts(0.5)} FROM {rows} {group}) m JOIN ({auc}) a {on} {where}"""


def _report(rows: str) -> str:
    return " UNION ALL ".join(
        [
            _level(rows, 0, "", "'overall'"),
            _level(rows, 1, "source", "'source=' || m.k"),
            _level(rows, 2, "channel", "'channel=' || m.k"),
        ]
    )


# Attached sources: three rows of four have one.
_JOINED = f"""
{_SCORED},
joined AS (
  SELECT s.id, s.channel, s.label, s.prob_phish, d.source
  FROM scored s LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 <> 0) d ON s.doc_id = d.doc_id)"""


_EVALUATED = f"""
{_SCORED},
parts AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'test' END AS split FROM scored),
evaluated AS (
  SELECT split, 0.5::DOUBLE AS threshold, round({_ACCURACY}, 6) AS accuracy,
         round({_PRECISION}, 6) AS precision_phish, round({_RECALL}, 6) AS recall_phish,
         round({_F1}, 6) AS f1_phish, round(({_F1} + {_F0}) / {_PRESENT}, 6) AS f1_macro,
         round(roc_auc, 6) AS roc_auc, tp + fp + fn + tn AS n, tp + fn AS n_phish
  FROM (SELECT split, {_counts(0.5)} FROM parts GROUP BY split)
  JOIN ({_auc('parts', 'split')}) USING (split))"""


def _share(draw: str, size: str, out: str, source: str) -> str:
    return f"""
SELECT *, whole + (row_number() OVER (ORDER BY rest DESC, stratum)
                   <= {draw} - sum(whole) OVER ())::BIGINT AS {out}
FROM (SELECT *, {size} * {draw} // total AS whole, {size} * {draw} % total AS rest FROM {source})"""


_SPLIT = f"""
hashed AS (
  SELECT *, label || '_' || channel AS stratum, sha256('42|' || id) AS h FROM messages),
strata AS (SELECT stratum, count(*) AS size, sum(count(*)) OVER ()::BIGINT AS total FROM hashed GROUP BY stratum),
step1 AS ({_share('(total - ceil(total * 0.2::DOUBLE)::BIGINT)', 'size', 'n_train', 'strata')}),
held AS (
  SELECT stratum, n_train, size - n_train AS hold, sum(size - n_train) OVER ()::BIGINT AS total FROM step1),
step2 AS ({_share('(total - ceil(total * 0.5::DOUBLE)::BIGINT)', 'hold', 'n_val', 'held')}),
split AS (
  SELECT id, text, channel, label, source, lang,
         CASE WHEN place <= n_train THEN 'train' WHEN place <= n_train + n_val THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS place FROM hashed)
  JOIN step2 USING (stratum))"""


def _digest(columns: tuple[str, ...]) -> str:
    parts = [f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '~')" for c in columns]
    return f"sha256({' || chr(124) || '.join(parts)})"


def _checksum(columns: tuple[str, ...]) -> str:
    lanes = [
        f"sum(('0x' || substr({_digest(columns)}, {1 + 16 * i}, 16))::UBIGINT::HUGEINT)::VARCHAR"
        for i in range(4)
    ]
    return f"sha256(count(*) || '|' || {' || chr(124) || '.join(lanes)})"


_CANONICAL = ("id", "text", "channel", "label", "source", "lang")
_MANIFEST = f"""
manifest AS (
  SELECT split, count(*) AS rows, sum(label)::BIGINT AS n_phish,
         count(*) FILTER (channel = 'email') AS n_email, count(*) FILTER (channel = 'sms') AS n_sms,
         {_checksum(_CANONICAL)} AS sha256
  FROM split GROUP BY split)"""

_KEY = "sha256(coalesce(text, '') || 'some-model' || '4' || '0.9' || '42')"
_STRIP = f"regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_ANSWERS = f"""
{_TURNS},
answers AS (
  SELECT *, CASE WHEN turn % 3 = 2 THEN []::VARCHAR[] ELSE
    list_filter(list_transform(['  ' || text || ' v1 ', lower(text), '', source], lambda x: {_STRIP}),
                lambda x: x <> '' AND lower(x) <> lower(text)) END AS paraphrases
  FROM turns)"""


def _expanded(rows: str) -> str:
    return f"""
SELECT id || '__para_' || (u.i - 1) AS id, u.t AS text, channel, label,
       'nz_synth_para' AS source, lang
FROM {rows}, unnest(paraphrases) WITH ORDINALITY AS u(t, i)"""


def _pick(options: tuple[str, ...], slot: str) -> str:
    listed = ", ".join("'" + o + "'" for o in options)
    place = f"('0x' || substr(sha256('42|' || key || '|{slot}'), 1, 8))::BIGINT % {len(options)}"
    return f"([{listed}])[1 + {place}]"


_TEMPLATES = (
    ("email", 1, ("Dear {name}, {amt} at {dom}.", "{dom} asks {name} of {place}"), ("a.example", "b.example")),
    ("sms", 1, ("{name}: {amt}",), ("a.example",)),
    ("email", 0, ("Hello {name}, lunch in {place}?", "Thanks {name}", "{amt} received"), ("c.example",)),
    ("sms", 0, ("Late, sorry {name}", "See {dom}"), ("c.example", "d.example", "e.example")),
)


def _template_rows() -> str:
    branches = []
    for channel, label, templates, domains in _TEMPLATES:
        amount = f"ltrim({_pick(('$3.20', '$12.40', '$1,240.00'), 'amt')}, '$')"
        filled = f"replace({_pick(templates, 'template')}, '{{name}}', c_name)"
        filled = f"replace({filled}, '{{amt}}', {amount})"
        filled = f"replace({filled}, '{{place}}', {_pick(('Napier', 'Nelson'), 'place')})"
        filled = f"replace({filled}, '{{dom}}', {_pick(domains, 'dom')})"
        branches.append(
            f"SELECT 'nz_synth_' || key AS id, {filled} AS text, '{channel}' AS channel, "
            f"{label} AS label, 'nz_synth' AS source, 'en' AS lang "
            f"FROM (SELECT *, '{channel}_{label}_' || c_custkey AS key FROM customer)"
        )
    return " UNION ALL ".join(branches)


def statements() -> dict[str, str]:
    page_host = "(SELECT page_id, url, " + _host("url") + " AS host FROM pages)"
    page_text = "(SELECT page_id, url || ' ' || html AS text FROM pages)"
    urls = f"list_transform(regexp_extract_all(text, '{_URL}'), lambda u: {_host('u')})"
    domains = f"list_transform(hosts, lambda h: {_domain('h', ('com', 'org', 'example.net'))})"
    keyed = f"WITH {_TURNS}, keyed AS (SELECT *, {_KEY} AS cache_key FROM turns)"
    known = "(SELECT DISTINCT cache_key FROM keyed WHERE conv_id % 2 = 0)"
    report = _report("scored")
    return {
        "conform_documents": f"WITH {_MESSAGES} SELECT {', '.join(_CANONICAL)} FROM messages",
        "row_ids_stable": "SELECT doc_id, 'doc_documents.parquet_' || doc_id AS id FROM documents",
        "row_ids_dense": "SELECT doc_id, 'doc_' || doc_id AS id FROM documents",
        "sources_roundtrip": f"""WITH {_MESSAGES}, {_TURNS}
            SELECT {', '.join(_CANONICAL)} FROM messages
            UNION ALL SELECT {', '.join(_CANONICAL)} FROM turns""",
        "union_dedup_sources": f"""WITH {_MESSAGES}, {_TURNS}
            SELECT sha256(norm) AS digest, 1::BIGINT AS kept, min(source) AS won FROM (
              SELECT {_norm('text')} AS norm, 'documents' AS source FROM messages
              UNION ALL SELECT {_norm('text')}, 'turns' FROM turns) GROUP BY norm""",
        "union_dedup_partitioned": f"""WITH {_MESSAGES}, {_TURNS}
            SELECT sha256(norm) AS digest, 1::BIGINT AS kept, min(source) AS won FROM (
              SELECT {_norm('text')} AS norm, 'documents' AS source FROM messages
              UNION ALL SELECT {_norm('text')}, 'turns' FROM turns) GROUP BY norm""",
        "prepare_corpus": f"""WITH {_MESSAGES.replace('messages AS', 'labelled AS')}, {_TURNS},
            everything AS (
              SELECT id, text, channel, label, source, lang, 1 AS place, doc_id AS a, 0 AS b FROM labelled
              UNION ALL SELECT id, text, channel, label, source, lang, 2, conv_id, turn FROM turns),
            messages AS (
              SELECT id, text, channel, label, source, lang FROM (
                SELECT *, row_number() OVER (PARTITION BY {_norm('text')} ORDER BY place, a, b) AS first
                FROM everything) WHERE first = 1),
            {_SPLIT}, {_MANIFEST} SELECT * FROM manifest""",
        "normalize_text": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
        "nfkc_lower": "SELECT doc_id, lower(nfc_normalize(text)) AS norm FROM documents",
        "nfkc_forms": """
            SELECT o_orderkey, lower('fi' || o_orderpriority || 'K1ff é') AS norm FROM orders""",
        "built_cues": """
            SELECT c_custkey, (c_custkey % 2 = 0)::INT AS nzd_mention_count,
                   (1 + (c_custkey % 3 = 0)::INT)::INT AS url_count,
                   (c_custkey % 7 = 0)::INT AS suspicious_govt_lookalike,
                   (c_custkey % 7 BETWEEN 1 AND 4)::INT AS suspicious_bank_lookalike,
                   (length(c_mktsegment) - length(translate(c_mktsegment, 'AEO', '')))::INT AS homoglyph_chars,
                   (c_custkey % 3 = 0)::INT AS has_punycode
            FROM customer""",
        "registered_domain_kinds": f"""
            SELECT page_id, CASE page_id % 9 WHEN 5 THEN 'www.ck' WHEN 8 THEN 'internal'
              ELSE replace(host, '.', '-') || '.' || ['top', 'com.au', 'co.uk', 'click', 'any.ck', '', 'nz', 'govt.nz'][1 + page_id % 9]
              END AS domain FROM {page_host}""",
        "fold_accents": "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents",
        "token_ngrams": f"""WITH {_grams('documents', 'doc_id')}
            SELECT d.doc_id, coalesce(n_distinct, 0)::INT AS n_distinct,
                   coalesce(n_grams, 0)::INT AS n_grams, sha256(coalesce(lines, '')) AS digest
            FROM documents d LEFT JOIN (
              SELECT key, count(*) AS n_distinct, sum(tf) AS n_grams,
                     string_agg(term || ':' || tf, chr(10) ORDER BY term) AS lines
              FROM tf GROUP BY key) ON d.doc_id = key""",
        "term_cues": f"SELECT doc_id, {_term_cues()} FROM documents",
        "pattern_cues": f"SELECT doc_id, {_PATTERN_CUES}, {_LAST_CUES} FROM documents",
        "cue_vector": f"""
            SELECT page_id, {_term_cues()}, {_PATTERN_CUES},
              list_sum(list_transform(domains, lambda c: {_like('c', 'blog.example.net')}))::INT
                AS suspicious_govt_lookalike,
              list_sum(list_transform(domains, lambda c: {_like('c', 'example.com')}))::INT
                AS suspicious_bank_lookalike,
              {_LAST_CUES}
            FROM (SELECT *, {domains} AS domains FROM (SELECT *, {urls} AS hosts FROM {page_text}))""",
        "page_registered_domain": f"""
            SELECT page_id, host, {_domain('host', _SUFFIXES)} AS domain FROM {page_host}""",
        "page_lookalikes": f"""
            SELECT page_id, ({_like('d', 'example.com')} + {_like('d', 'example.org')}
                             + {_like('d', 'net.example')})::INT AS lookalikes
            FROM (SELECT page_id, {_domain('host', _SUFFIXES)} AS d FROM {page_host})""",
        "page_lookalikes_table": f"""
            WITH legit AS (
              SELECT CASE WHEN c_custkey % 7 = 0 THEN lower(replace(c_name, '#', '')) || '.com'
                ELSE substr('thanesrerthinat', (c_custkey % 11 + 1)::INT, (c_custkey % 5 + 1)::INT) || '.'
                  || ['com', 'org', 'example.net'][(c_custkey % 3 + 1)::INT] END AS legit
              FROM customer
            ), elements AS (
              SELECT page_id, unnest(CASE WHEN len(domains) = 0 THEN [NULL] ELSE domains END) AS d
              FROM (SELECT *, {domains} AS domains FROM (SELECT *, {urls} AS hosts FROM {page_text}))
            )
            SELECT e.page_id, count(l.legit)::BIGINT AS lookalikes
            FROM elements e LEFT JOIN legit l
              ON contains(e.d, split_part(l.legit, '.', 1)) AND e.d <> l.legit
            GROUP BY e.page_id""",
        "normalize_dedup": f"""
            SELECT doc_id, text, lang, source, n_chars FROM (
              SELECT *, row_number() OVER (PARTITION BY {_norm('text')} ORDER BY doc_id) AS place
              FROM documents) WHERE place = 1""",
        "dedup_summary": f"""
            SELECT sum(n)::BIGINT AS rows_before, count(*) AS rows_after, sum(n - 1)::BIGINT AS rows_dropped
            FROM (SELECT count(*) AS n FROM documents GROUP BY {_norm('text')})""",
        "source_summary": f"""WITH {_SCORED}
            SELECT source, channel, count(*) AS rows, sum(label)::BIGINT AS n_phish
            FROM scored GROUP BY source, channel""",
        "stratified_split": f"WITH {_MESSAGES}, {_SPLIT} SELECT id, split FROM split",
        "split_manifest": f"WITH {_MESSAGES}, {_SPLIT}, {_MANIFEST} SELECT * FROM manifest",
        "splits_roundtrip": f"""WITH {_MESSAGES}, {_SPLIT}
            SELECT {', '.join(_CANONICAL)}, split FROM split""",
        "manifest_sink": f"""WITH {_MESSAGES}, {_SPLIT}, {_MANIFEST}
            SELECT 42::BIGINT AS seed, * FROM manifest""",
        "content_checksum": f"""
            SELECT lang, count(*) AS rows, {_checksum(('doc_id', 'text', 'source', 'n_chars'))} AS sha256
            FROM documents GROUP BY lang""",
        "class_weights": f"""WITH {_SCORED}
            SELECT label, n, round(sum(n) OVER () / count(*) OVER () / n, 6)::DOUBLE AS weight
            FROM (SELECT label, count(*)::DOUBLE::BIGINT AS n FROM scored GROUP BY label)""",
        "capped_sample": """
            SELECT * FROM documents ORDER BY sha256('42|' || doc_id) LIMIT 150""",
        "threshold_predictions": f"""WITH {_SCORED}
            SELECT id, (prob_phish >= 0.35)::INT AS predicted FROM scored""",
        "confusion": f"WITH {_SCORED} SELECT source, {_counts(0.5)} FROM scored GROUP BY source",
        "classification_metrics": f"""WITH {_SCORED}
            SELECT 0.4::DOUBLE AS threshold, round({_ACCURACY}, 6) AS accuracy,
                   round({_PRECISION}, 6) AS precision_phish, round({_RECALL}, 6) AS recall_phish,
                   round({_F1}, 6) AS f1_phish,
                   round(({_F1} + {_F0}) / {_PRESENT}, 6) AS f1_macro,
                   round(roc_auc, 6) AS roc_auc, tp + fp + fn + tn AS n, tp + fn AS n_phish
            FROM (SELECT {_counts(0.4)} FROM scored), ({_auc('scored', '')})""",
        "roc_auc": f"""WITH {_SCORED}
            SELECT channel, round(roc_auc, 6) AS roc_auc FROM ({_auc('scored', 'channel')})""",
        "selective_metrics": f"""WITH {_SCORED}
            SELECT round(n_kept::DOUBLE / n, 6) AS coverage, n_kept, n - n_kept AS n_deferred,
                   round({_ACCURACY}, 6) AS selective_accuracy,
                   round({_PRECISION}, 6) AS selective_precision_phish,
                   round({_RECALL}, 6) AS selective_recall_phish,
                   round({_F1}, 6) AS selective_f1_phish
            FROM (SELECT count(*) AS n, count(*) FILTER (abs(prob_phish - 0.5) >= 0.15) AS n_kept,
                         {_counts(0.5, 'abs(prob_phish - 0.5) >= 0.15')} FROM scored)""",
        "evaluate_splits": f"WITH {_EVALUATED} SELECT * FROM evaluated",
        "metrics_sink": f"""WITH {_EVALUATED}
            SELECT 42::BIGINT AS seed, 0.0::DOUBLE AS fit_seconds, 'fixed' AS rule, * FROM evaluated""",
        "source_join": f"WITH {_JOINED} SELECT * FROM joined",
        "stratified_report": f"WITH {_SCORED} {report}",
        "report_sink": f"WITH {_SCORED} {report}",
        "probs_roundtrip": f"WITH {_SCORED} SELECT id, channel, label, prob_phish FROM scored",
        "term_statistics": f"""WITH {_grams('documents', 'doc_id', 1)}
            SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term""",
        "vocabulary_topk": f"""
            WITH {_grams('documents', 'doc_id')}, {_vocabulary('documents', 2000)}
            SELECT term, df, total, round(idf, 6) AS idf FROM vocabulary""",
        "tfidf_weights": f"""
            WITH {_ALL}, {_grams('messages', 'id')}, {_vocabulary('messages', 500)}, {_WEIGHTS}
            SELECT id, term, round(weight, 6) AS weight FROM weights""",
        "tfidf_held_out": f"""
            WITH {_ALL}, {_grams('messages', 'id')},
            sides AS (SELECT tf.*, channel FROM tf JOIN messages m ON tf.key = m.id),
            n AS (SELECT count(*) AS n FROM messages WHERE channel = 'email'),
            vocabulary AS (
              SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf
              FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM sides
                    WHERE channel = 'email' GROUP BY term), n
              WHERE df >= 2 AND df <= 0.95::DOUBLE * n ORDER BY total DESC, term LIMIT 500),
            raw AS (
              SELECT key, term, (1 + ln(tf)) * idf AS raw FROM sides JOIN vocabulary USING (term)
              WHERE channel = 'sms')
            SELECT key AS id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)), 6) AS weight
            FROM raw""",
        "assembled_features": f"""
            WITH {_ALL}, {_grams('messages', 'id')}, {_vocabulary('messages', 500)}, {_WEIGHTS},
            cues AS (SELECT id, {_term_cues()}, {_PATTERN_CUES} FROM messages),
            pairs AS (
              SELECT 'term=' || term AS feature, weight AS value FROM weights
              {' '.join(f"UNION ALL SELECT 'cue={c}', {c}::DOUBLE FROM cues WHERE {c} <> 0" for c in _CUE_WEIGHTS)})
            SELECT feature, count(*) AS n, round(sum(value), 6) AS total FROM pairs GROUP BY feature""",
        "linear_score": _linear(),
        "model_roundtrip": _linear(),
        "score_duplicate_ids": _linear("doc_id % 7 AS id"),
        "explain_fixed_model": f"""
            WITH {_ALL}, {_grams('messages', 'id')}, {_vocabulary('messages', 500)}
            SELECT term AS feature, 'term' AS kind,
                   round((('0x' || substr(sha256('42|' || term), 1, 8))::BIGINT % 2001 - 1000) / 500::DOUBLE, 6) AS weight
            FROM vocabulary
            {' '.join(f"UNION ALL SELECT '{c}', 'cue', {w}::DOUBLE" for c, w in _CUE_WEIGHTS.items())}""",
        "experiment_callers_model": f"""
            WITH {_MESSAGES}, {_SPLIT},
            parts AS (
              SELECT *, 1 / (1 + exp(-(length(coalesce(text, '')) / 1000::DOUBLE - 1))) AS prob_phish
              FROM split WHERE split <> 'train')
            SELECT split, 0.5::DOUBLE AS threshold, round({_ACCURACY}, 6) AS accuracy,
                   round({_PRECISION}, 6) AS precision_phish, round({_RECALL}, 6) AS recall_phish,
                   round({_F1}, 6) AS f1_phish, round(({_F1} + {_F0}) / {_PRESENT}, 6) AS f1_macro,
                   round(roc_auc, 6) AS roc_auc, tp + fp + fn + tn AS n, tp + fn AS n_phish
            FROM (SELECT split, {_counts(0.5)} FROM parts GROUP BY split)
            JOIN ({_auc('parts', 'split')}) USING (split)""",
        "fit_is_stationary": f"""
            WITH {_MESSAGES}, {_grams('messages', 'id')}, {_vocabulary('messages', 2000)}
            SELECT count(*) AS n_terms, count(*) AS n_stationary, 0.5::DOUBLE AS mean_prob
            FROM vocabulary""",
        "scored_by_callers_model": """
            SELECT doc_id, round(1 / (1 + exp(-(length(coalesce(text, '')) / 1000::DOUBLE - 1))), 6)
              AS prob_phish FROM documents""",
        "cache_keys": f"{keyed} SELECT id, cache_key FROM keyed",
        "cache_hits": f"""{keyed} SELECT id, cache_key, text AS answer FROM keyed
            WHERE cache_key IN {known}""",
        "cache_pending": f"""{keyed} SELECT DISTINCT cache_key, text FROM keyed
            WHERE cache_key NOT IN {known}""",
        "prompts": f"""WITH {_TURNS}
            SELECT id, 'Give 4 rewordings as JSON.' || chr(10) || chr(10) || 'ORIGINAL:' || chr(10)
              || coalesce(text, '') || chr(10) || chr(10)
              || 'Respond with valid JSON only: {{"paraphrases": ["...", "..."]}}' AS prompt
            FROM turns""",
        "parse_responses": f"""WITH {_ANSWERS}
            SELECT id, len(paraphrases)::INT AS n, array_to_string(paraphrases, '|') AS joined
            FROM answers""",
        "expand_paraphrases": f"WITH {_ANSWERS} {_expanded('answers')}",
        "augment": f"""WITH {_TURNS},
            answers AS (
              SELECT *, list_filter(list_transform(
                  ['again ' || text, text, text || ' [' || length(text) || ']'], lambda x: {_STRIP}),
                lambda x: x <> '' AND lower(x) <> lower(text)) AS paraphrases FROM turns)
            {_expanded('answers')}""",
        "augment_summary": f"""WITH {_ANSWERS}
            SELECT count(*) AS source_rows, count(*) FILTER (len(paraphrases) > 0) AS done,
                   count(*) FILTER (len(paraphrases) = 0) AS skipped,
                   sum(len(paraphrases))::BIGINT AS paraphrased_rows FROM answers""",
        "template_rows": _template_rows(),
    }
