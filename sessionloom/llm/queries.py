"""The operators' registered queries: each over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    report = quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op2_sql(alpha: float = 0.005, delta: float = 0.05) -> str:
    """Words and lines as rows; the exact binomial bound by the gamma function."""
    from .quality_rules import FEATURES, GOOD_WEIGHT, RULES

    fails = lambda rule, cut: f"(100 * {RULES[rule][0]} {'>' if RULES[rule][2] else '<'} ({cut}) * {RULES[rule][1]})"  # noqa: E731
    rungs = ", ".join(f"('{r}', {i}, {c})" for r, (*_, ladder) in RULES.items() for i, c in enumerate(ladder))
    case = lambda cut: "CASE rule " + " ".join(f"WHEN '{r}' THEN {fails(r, cut)}" for r in RULES) + " END"  # noqa: E731
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') AS w FROM docs)
), windows AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS k FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), places AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs
), per_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id
), feats AS (
  SELECT d.doc_id, d.stratum, d.text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d
  LEFT JOIN (SELECT doc_id, count(*) AS n_words, sum(length(word))::bigint AS word_chars FROM words GROUP BY doc_id) USING (doc_id)
  LEFT JOIN per_line USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n_repeat_words FROM places GROUP BY doc_id) USING (doc_id)
), judged AS (
  SELECT *, md5(text) AS print, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM feats
), rungs(rule, rung, cut) AS (VALUES {rungs}),
labelled AS (
  SELECT j.*, quality FROM judged j
  JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
), known AS (
  SELECT stratum, print, min(quality) AS quality, {", ".join(f"min({c}) AS {c}" for c in FEATURES)} FROM labelled GROUP BY stratum, print
), strata AS (
  SELECT stratum, count(*) FILTER (WHERE quality = 1) AS n, {delta} / (count(*) OVER () * {len(RULES)}) AS level FROM known GROUP BY stratum
), bounds AS (
  SELECT stratum, n, level, k, sum(exp(lgamma(n + 1) - (CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END) - (CASE WHEN n = k THEN 0 ELSE lgamma(n - k + 1) END) + k * ln({alpha}) + (n - k) * ln(1 - {alpha}))) OVER (PARTITION BY stratum ORDER BY k) AS cdf
  FROM (SELECT *, unnest(range(0, floor(n * {alpha})::bigint + 1)) AS k FROM strata WHERE n > 0)
), most AS (
  SELECT stratum, coalesce(max(k) FILTER (WHERE cdf <= level), -1) AS most FROM bounds GROUP BY stratum
), tried AS (
  SELECT stratum, rule, rung, cut, count(*) FILTER (WHERE quality = 0 AND {case("cut")}) AS bad, count(*) FILTER (WHERE quality = 1 AND {case("cut")}) AS good
  FROM known, rungs GROUP BY ALL
), chosen AS (
  SELECT stratum, rule, arg_max(cut, (bad - {GOOD_WEIGHT} * good) * 1000 - rung) AS cut
  FROM tried JOIN most USING (stratum) WHERE good <= most AND bad > {GOOD_WEIGHT} * good GROUP BY stratum, rule
), rejected AS (
  SELECT DISTINCT doc_id FROM judged JOIN chosen USING (stratum) WHERE {case("cut")}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS p FROM docs WHERE length(x) >= 400)
), repeated AS (
  SELECT doc_id, p FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)
), islands AS (
  SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM
    (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 1 ELSE 0 END AS fresh FROM repeated))
  GROUP BY doc_id, island
), pieces AS (
  SELECT i.doc_id, lo, hi, substr(x, 2 * coalesce(lag(hi) OVER w, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER w, 0))) AS kept
  FROM islands i JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY i.doc_id ORDER BY lo)
), per AS (
  SELECT doc_id, sum(hi - lo)::bigint AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY lo) AS head, max(hi) AS last FROM pieces GROUP BY doc_id
)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN per USING (doc_id)
"""


def op4_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_tokens import piece_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, secret_spans, span_text

    found = secret_spans(_table(spark, sf_dir, "documents"))
    base = span_text(F.filter("spans", lambda x: x["kind"] < len(BASE)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _op5_sql() -> str:
    """Every kind's matches and the texts between them by regular expression; links by comparing parts of a document."""
    from .secret_scan import BASE, KINDS, SCOPE, WEAK

    quote = lambda x: "'" + x.replace("'", "''") + "'"  # noqa: E731
    hits = []
    for i, (_, pattern, least) in enumerate((*BASE, *WEAK)):
        text = "coalesce(text, '')"
        value = f"regexp_extract_all({text}, {quote(pattern)}, {2 if KINDS[i] == 'assign' else 0})"
        ok = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if KINDS[i] == "secret" else f"length(v) >= {least}"
        hits.append(
            f"SELECT doc_id, {i} AS kind, i, g, m, {ok} AS ok FROM (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(list_slice(gs, 1, len(ms))) AS g, unnest(ms) AS m, unnest(vs) AS v FROM "
            f"(SELECT doc_id, regexp_split_to_array({text}, {quote(pattern)}) AS gs, regexp_extract_all({text}, {quote(pattern)}, 0) AS ms, {value} AS vs FROM documents))"
        )
    n = len(BASE)
    names = ", ".join(quote(k) for k in KINDS)
    return f"""
WITH hits AS ({" UNION ALL ".join(hits)}),
parts AS (
  SELECT doc_id, kind, e - length(m) AS s, e FROM (
    SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM hits) WHERE ok
), roles AS (
  SELECT *, CASE WHEN kind IN (1, 3) THEN 'i' WHEN kind IN (0, 2, 4) THEN 's' ELSE 'e' END AS role FROM parts
), near AS (
  SELECT a.doc_id, a.kind, a.s, a.e, a.role,
    bool_or(b.role = 'i' AND b.e >= a.s - {SCOPE} AND b.s <= a.e + {SCOPE}) AS near_i,
    bool_or(b.role = 's' AND b.e >= a.s - {SCOPE} AND b.s <= a.e + {SCOPE}) AS near_s,
    bool_or(b.kind < {n} AND b.s < a.e AND b.e > a.s) AS covered
  FROM roles a JOIN roles b ON a.doc_id = b.doc_id AND NOT (a.kind = b.kind AND a.s = b.s) WHERE a.kind >= {n} GROUP BY ALL
), spans AS (
  SELECT doc_id, kind, s, e FROM parts WHERE kind < {n}
  UNION ALL
  SELECT doc_id, kind, s, e FROM near WHERE NOT covered AND CASE role WHEN 'i' THEN near_s WHEN 's' THEN near_i ELSE near_i AND near_s END
), told AS (
  SELECT *, list_extract([{names}], kind + 1) || ':' || s::bigint || ':' || e::bigint AS t FROM spans
), per AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(t, ',' ORDER BY s, kind) FILTER (WHERE kind < {n}) AS base, string_agg(t, ',' ORDER BY s, kind) AS spans
  FROM told GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import vector_groups

    return vector_groups(_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN deg USING (vec_id)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"), columns=["doc_id"])


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE f.k IS NOT NULL AND f.top <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL OR f.top = l.doc_id), '')) AS kept_sha256
FROM keyed l LEFT JOIN frequent f ON f.k = l.k
GROUP BY l.doc_id
"""

def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op11_sql(k: int = 10) -> str:
    from .lexical_search import LOWER, TERM, UPPER

    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, {terms} AS terms FROM documents),
lengths AS (SELECT doc_id, row, len(terms) AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::bigint AS n_terms FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM postings, whole GROUP BY term, n_docs
), scores AS (
  SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row), whole GROUP BY item_id, row
)
SELECT item_id, rank::int AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores JOIN lengths USING (row) WHERE score > 0)
WHERE rank <= {k}
"""


def op12_talk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .talk_repair import repair_report

    return repair_report(_table(spark, sf_dir, "conversations"))


#: Left to right through the places of the expression, a row at a time; crc32 from its definition.
OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), talk AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw
  FROM conversations, steps
), hurt AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM talk WHERE draw <> 0
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ 	-]') AS blank,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM hurt
), seen AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
), rows AS (
  SELECT *, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-]*$') AS unfinished FROM seen
), numbers AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
    count(*) FILTER (WHERE unfinished) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM rows GROUP BY conv_id
), moves(p, q, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edits AS (
  SELECT p, q, initial, 'K' AS edit, 0 AS price FROM moves
  UNION ALL SELECT p, q, NULL, 'R', 2 FROM moves WHERE initial <> 's'
  UNION ALL SELECT p, p, NULL, 'D', 3 FROM range(4) r(p)
), fills(p, q, price, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
walk(conv_id, pos, place, best) AS (
  SELECT conv_id, 0::bigint, q::bigint, printf('%08d', price) || letters FROM numbers, fills WHERE p = 0
  UNION ALL
  SELECT r.conv_id, r.pos, f.q::bigint,
    min(printf('%08d', substr(best, 1, 8)::bigint + e.price + f.price + CASE WHEN unfinished AND edit <> 'D' THEN 1 ELSE 0 END) || substr(best, 9) || edit || letters)
  FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1
  JOIN edits e ON e.p = w.place AND (e.initial IS NULL OR e.initial = r.initial) AND (edit = 'D' OR NOT (blank OR again)) JOIN fills f ON f.p = e.q
  GROUP BY r.conv_id, r.pos, f.q
), ends AS (
  SELECT n.*, substr(best, 1, 8)::bigint AS cost, substr(best, 9) AS audit
  FROM numbers n JOIN (SELECT conv_id, pos, min(best) AS best FROM walk WHERE place IN (0, 3) GROUP BY ALL) w ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.pos = n.n
), letters AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit, sum((substr(audit, i, 1) <> 'I')::int) OVER o AS pos, sum((substr(audit, i, 1) <> 'D')::int) OVER o AS slot, sum((substr(audit, i, 1) <> 'D')::int) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM ends) WINDOW o AS (PARTITION BY conv_id ORDER BY i)
), lines AS (
  SELECT l.conv_id, i, CASE edit WHEN 'K' THEN role ELSE CASE WHEN (slot - n % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END AS line
  FROM letters l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.pos = l.pos WHERE edit <> 'D'
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS said FROM lines GROUP BY conv_id) s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY same) AS group_size,
  doc_id IS NOT DISTINCT FROM first(doc_id) OVER w AND n = first(n) OVER w AS kept, sha256(same) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ 	-]', '', 'g') AS same FROM documents)
WINDOW w AS (PARTITION BY same ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_piece_tokens": op4_piece_tokens,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_simhash": op8_simhash,
    "op9_lm_score": op9_lm_score,
    "op10_line_dedup": op10_line_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_talk_repair": op12_talk_repair,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": _op2_sql(),
    "op3_suffix_dedup": OP3_SQL,
    "op5_secret_scan": _op5_sql(),
    "op7_vector_dedup": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_lexical_search": _op11_sql(),
    "op12_talk_repair": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
