"""DuckDB SQL for every query that has a SQL form.

Independent formulations (RE2 regexes, list functions, plain windows), run by
the checker on the same parquet tables.  RE2 has no look-around and an
ASCII ``\\b``, so word-boundary patterns are matched on a copy of the text in
which every word run is wrapped in CHR(2) ... CHR(3).
"""

from __future__ import annotations

from factlake.functions import vocab

# white space beyond ASCII counts, as in Python
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN2 = r"[\p{L}\p{M}\p{N}_]{2,}"
WORD = r"[\p{L}\p{M}\p{N}_]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sentences(x: str) -> str:
    return (f"string_split(regexp_replace({strip(f'coalesce({x}, {q(str())})')}, "
            f"'([.?!])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))")


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(TOKEN2)})"


def stop_list(language: str = "portuguese") -> str:
    return "[" + ", ".join(q(w) for w in vocab.stop_words(language)) + "]"


def no_stop(arr: str, language: str = "portuguese") -> str:
    return f"list_filter({arr}, lambda t: NOT list_contains({stop_list(language)}, t))"


# ---------------------------------------------------------------- centrality
def centrality_ctes(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs ``s`` (sentences) and ``r`` (ranked sentences with score)."""
    return f"""
d AS (SELECT {key} AS doc_id, {sentences(text)} AS sents FROM {src}),
s AS (SELECT doc_id, len(sents) AS n_sent, unnest(sents) AS sentence,
             CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS sid FROM d),
s2 AS (SELECT *, len({tokens('sentence')}) AS n_tok FROM s),
t AS (SELECT doc_id, sid, n_sent, unnest({tokens('sentence')}) AS term FROM s),
tf AS (SELECT doc_id, sid, n_sent, term, count(*) AS tf FROM t GROUP BY ALL),
dfq AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT tf.doc_id, tf.sid, tf.n_sent, tf.term,
             tf.tf * (ln((tf.n_sent + 1.0) / (dfq.df + 1.0)) + 1.0) AS w
      FROM tf JOIN dfq USING (doc_id, term)),
u AS (SELECT doc_id, sid, n_sent, term,
             w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sid)) AS u FROM w),
c AS (SELECT doc_id, term, sum(u) AS c FROM u GROUP BY ALL),
sc AS (SELECT u.doc_id, u.sid, sum(u.u * c.c) / max(u.n_sent) AS raw
       FROM u JOIN c USING (doc_id, term) GROUP BY ALL),
r AS (SELECT s2.doc_id, s2.sid, s2.sentence, s2.n_tok,
             round(coalesce(sc.raw, 0.0), 6) AS score,
             row_number() OVER (PARTITION BY s2.doc_id
                                ORDER BY round(coalesce(sc.raw, 0.0), 6) DESC, s2.sid) AS rk,
             sum(s2.n_tok) OVER (PARTITION BY s2.doc_id) AS doc_tok
      FROM s2 LEFT JOIN sc USING (doc_id, sid))"""


def tfidf_summary_ctes(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Adds CTE ``ts(doc_id, summary)``."""
    return centrality_ctes(src, key, text) + """,
ts AS (SELECT doc_id,
              CASE WHEN max(doc_tok) > 0 THEN string_agg(sentence, ' ' ORDER BY rk) ELSE '' END AS summary
       FROM r WHERE rk <= 5 GROUP BY doc_id)"""


SQL = {
    "sentence_centrality_top5": "WITH " + centrality_ctes() +
        "\nSELECT doc_id, rk, sid, score, sentence FROM r WHERE rk <= 5",
    "tfidf_summary": "WITH " + tfidf_summary_ctes() + "\nSELECT doc_id, summary FROM ts",
}


# ---------------------------------------------------------------- segmentation
WRAP = r"[\p{L}\p{M}\p{N}_]+"


def wrap(x: str) -> str:
    """Wrap every word run in CHR(2)..CHR(3): explicit word boundaries for RE2."""
    return f"regexp_replace({x}, '({WRAP})', chr(2) || '\\1' || chr(3), 'g')"


def unwrap(x: str) -> str:
    return f"replace(replace({x}, chr(2), ''), chr(3), '')"


def wrapped_connectives() -> str:
    import re
    alts = []
    for phrase in vocab.CONNECTIVES:
        out = ""
        for m in re.finditer(r"\w+|\W", phrase):
            tok = m.group()
            if re.fullmatch(r"\w+", tok):
                out += r"\x02" + tok + r"\x03"
            else:
                out += " " if tok == " " else re.escape(tok)
        alts.append(out)
    return "(" + "|".join(alts) + ")"


def marked_parts(x: str, marks: str = vocab.CLAUSE_MARKS, ci: bool = False) -> str:
    """List alternating text, separator, text, ... (a mark leaves an empty separator)."""
    pat = ("(?i)" if ci else "") + wrapped_connectives() + "|" + marks
    marked = f"regexp_replace({wrap(f'coalesce({x}, {q(str())})')}, {q(pat)}, chr(1) || '\\1' || chr(1), 'g')"
    return f"string_split({unwrap(marked)}, chr(1))"


def clause_parts(x: str) -> str:
    return f"list_filter(list_transform({marked_parts(x)}, lambda p: {strip('p')}), lambda p: p <> '')"


def after_que_parts(x: str) -> str:
    a = marked_parts(x, vocab.QUE_TERMINATOR, ci=True)
    return (f"(SELECT list_filter(list_transform(range(2, len(a) - 1, 2), lambda i: "
            f"CASE WHEN lower(a[i]) = 'que' OR ends_with(lower(a[i]), ' que') THEN {strip('a[i + 1]')} "
            f"ELSE '' END), lambda p: p <> '') FROM (SELECT {a} AS a))")


def long_form(src_sql: str, arr: str, name: str, key: str = "doc_id") -> str:
    return (f"SELECT {key}, CAST(generate_subscripts(_arr, 1) - 1 AS BIGINT) AS pos, unnest(_arr) AS {name} "
            f"FROM (SELECT {key}, {arr} AS _arr FROM {src_sql})")


def squash(x: str) -> str:
    return f"lower({strip(f'regexp_replace({x}, {q(chr(92) + 's+')}, {q(chr(32))}, {q(chr(103))})')})"


# the entities that occur in ``pages``; &amp; last, so that nothing is decoded twice
PAGE_ENTITIES = [("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def unescape(x: str) -> str:
    out = x
    for ent, ch in PAGE_ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def page_text(h: str) -> str:
    clean = f"regexp_replace({h}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')"
    ps = (f"list_transform(string_split(regexp_replace(_h, '(?i)<p(?:\\s[^>]*)?>', chr(1), 'g'), chr(1))[2:], "
          f"lambda x: regexp_replace(regexp_replace(x, '(?is)(</p>|</article>|</body>|<footer|<div).*$', ''), "
          f"'<[^>]*>', '', 'g'))")
    ss = (f"list_transform(regexp_extract_all(_h, '(?is)<span(?:\\s[^>]*)?>(.*?)</span>', 1), "
          f"lambda x: regexp_replace(x, '<[^>]*>', '', 'g'))")
    pt = squash(unescape(f"array_to_string({ps}, ' ')"))
    st = squash(unescape(f"array_to_string({ss}, ' ')"))
    return (f"(SELECT CASE WHEN length({pt}) > 0 THEN {pt} WHEN length({st}) > 0 THEN {st} END "
            f"FROM (SELECT {clean} AS _h))")


def chunks(x: str, m: int = 1200) -> str:
    t = strip(f"coalesce({x}, '')")
    sents = f"string_split(regexp_replace(_t, '([.?!])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"
    buf = "regexp_extract(acc, '[^\\x02]*$')"
    pre = "regexp_replace(acc, '[^\\x02]*$', '')"
    step = (f"lambda acc, s: CASE WHEN length({buf}) + length(s) + 1 <= {m} "
            f"THEN {pre} || {strip(f'{buf} || {q(chr(32))} || s')} "
            f"ELSE (CASE WHEN {buf} <> '' THEN acc || chr(2) ELSE {pre} END) || s END")
    packed = f"list_filter(string_split(list_reduce({sents}, {step}, ''), chr(2)), lambda c: c <> '')"
    cut = (f"flatten(list_transform({packed}, lambda c: list_transform(range(0, greatest(length(c), 1), {m}), "
           f"lambda i: substr(c, i + 1, {m}))))")
    return f"(SELECT CASE WHEN length(_t) <= {m} THEN [_t] ELSE {cut} END FROM (SELECT {t} AS _t))"


def quoted(x: str) -> str:
    return (f"list_transform(regexp_extract_all({x}, '\"[^\"\\n]*\"|''[^''\\n]*'''), "
            f"lambda s: substr(s, 2, length(s) - 2))")


SQL.update({
    "clause_split": long_form("documents", clause_parts("text"), "clause"),
    "after_que_clauses": long_form("documents", after_que_parts("text"), "clause"),
    "quoted_spans": long_form("documents", quoted("text"), "span"),
    "page_paragraphs": f"SELECT page_id, url, {page_text('html')} AS text FROM pages",
    "text_chunks": (f"SELECT doc_id, pos AS chunk_id, chunk, CAST(length(chunk) AS BIGINT) AS n_chars FROM ("
                    + long_form("documents", chunks("text"), "chunk") + ")"),
})


# ---------------------------------------------------------------- labels, evaluation, preparation
def in_list(x: str, values) -> str:
    return f"{x} IN (" + ", ".join(q(v) for v in values) + ")"


def norm_label(x: str) -> str:
    return f"lower({strip(f'CAST({x} AS VARCHAR)')})"


def gold_label(x: str) -> str:
    s = norm_label(x)
    v = f"try_cast({s} AS DOUBLE)"
    fin = f"({v} IS NOT NULL AND NOT isnan({v}) AND NOT isinf({v}))"
    return (f"CASE WHEN {x} IS NULL THEN NULL "
            f"WHEN {in_list(s, vocab.GOLD_FACTUAL)} THEN 'factual' "
            f"WHEN {in_list(s, vocab.GOLD_NON_FACTUAL)} THEN 'non-factual' "
            f"WHEN {fin} AND {v} >= 1.0 AND {v} < 2.0 THEN 'factual' "
            f"WHEN {fin} THEN 'non-factual' END")


def three_class(x: str) -> str:
    s = norm_label(x)
    return (f"CASE WHEN {x} IS NULL THEN 'non-factual' "
            f"WHEN {in_list(s, vocab.THREE_CLASS_NON_FACTUAL)} THEN 'non-factual' "
            f"WHEN {in_list(s, vocab.THREE_CLASS_NON_IMPORTANT)} THEN 'factual-non-important' "
            f"ELSE 'factual-checkworthy' END")


def binary_label(x: str) -> str:
    s = f"coalesce({norm_label(x)}, 'none')"
    return (f"CASE WHEN {in_list(s, vocab.BINARY_POSITIVE)} THEN 1 "
            f"WHEN {in_list(s, vocab.BINARY_NEGATIVE)} THEN 0 "
            f"WHEN contains({s}, 'fact') AND NOT contains({s}, 'non') THEN 1 ELSE 0 END")


RAW_LABELS = """(SELECT 'event_type' AS source, event_type AS raw FROM events
 UNION ALL SELECT 'value', CAST(CAST(floor(value) - 1 AS BIGINT) AS VARCHAR) FROM events
 UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM labels
 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels)"""

GOLD_PRED = f"(SELECT {gold_label('CAST(quality AS VARCHAR)')} AS gold, {gold_label('CAST(toxic AS VARCHAR)')} AS pred FROM labels)"
EVAL_LABELS = ["factual", "non-factual"]
LAB_VALUES = "(VALUES " + ", ".join(f"({q(v)}, {i})" for i, v in enumerate(EVAL_LABELS)) + ") AS lab(label, label_idx)"


def _safe(label: str) -> str:
    import re
    return re.sub(r"\W+", "_", label).strip("_")


CONF_COUNTS = (f"SELECT lab.label AS gold, CAST(lab.label_idx AS BIGINT) AS gold_idx, "
               + ", ".join(f"CAST(count(g.pred) FILTER (WHERE g.pred = {q(v)}) AS BIGINT) AS pred_{_safe(v)}"
                           for v in EVAL_LABELS)
               + f" FROM {LAB_VALUES} LEFT JOIN {GOLD_PRED} g ON g.gold = lab.label GROUP BY ALL")

_tot = " + ".join(f"pred_{_safe(v)}" for v in EVAL_LABELS)
CONF_NORM = (f"SELECT gold, gold_idx, "
             + ", ".join(f"CASE WHEN ({_tot}) = 0 THEN 0.0 ELSE round_even(pred_{_safe(v)} / ({_tot}), 3) END "
                         f"AS pred_{_safe(v)}" for v in EVAL_LABELS)
             + f" FROM ({CONF_COUNTS})")


def per_class(labels_sql: str) -> str:
    return f"""
pc AS (SELECT gold, pred, count(*) AS n FROM {GOLD_PRED} GROUP BY ALL),
lab AS {labels_sql},
m AS (SELECT lab.label,
        coalesce((SELECT sum(n) FROM pc WHERE pc.gold = lab.label AND pc.pred = lab.label), 0) AS tp,
        coalesce((SELECT sum(n) FROM pc WHERE pc.gold = lab.label), 0) AS gold_n,
        coalesce((SELECT sum(n) FROM pc WHERE pc.pred = lab.label), 0) AS pred_n FROM lab),
m2 AS (SELECT *, CASE WHEN pred_n = 0 THEN 0.0 ELSE tp / pred_n END AS precision,
              CASE WHEN gold_n = 0 THEN 0.0 ELSE tp / gold_n END AS recall FROM m),
m3 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
              ELSE 2 * precision * recall / (precision + recall) END AS f1,
              CAST(gold_n AS BIGINT) AS support FROM m2)"""


CLASS_REPORT = ("WITH " + per_class(f"(SELECT label FROM {LAB_VALUES})") + """
SELECT label AS row_label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m3
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m3
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m3
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM m3""")

MACRO = ("WITH " + per_class("(SELECT DISTINCT label FROM (SELECT gold AS label FROM pc UNION ALL "
                             "SELECT pred FROM pc) WHERE label IS NOT NULL)") + """
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
       round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM m3""")

BINARY = """WITH a AS (SELECT count(*) AS n, sum(CASE WHEN CAST(quality AS VARCHAR) = CAST(toxic AS VARCHAR) THEN 1 ELSE 0 END) AS ok,
  sum(CASE WHEN CAST(quality AS VARCHAR) = '1' AND CAST(toxic AS VARCHAR) = '1' THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN CAST(toxic AS VARCHAR) = '1' THEN 1 ELSE 0 END) AS pp,
  sum(CASE WHEN CAST(quality AS VARCHAR) = '1' THEN 1 ELSE 0 END) AS gp FROM labels),
b AS (SELECT *, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS precision, CASE WHEN gp = 0 THEN 0.0 ELSE tp / gp END AS recall FROM a)
SELECT round(ok / n, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM b"""

CLASS_TABLE = """(SELECT c.label, coalesce(k.n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS label FROM range(2)) c
  LEFT JOIN (SELECT quality AS label, count(*) AS n FROM labels GROUP BY ALL) k USING (label))"""
WEIGHTS_MEAN = f"""WITH t AS (SELECT label, n, (SELECT sum(n) FROM {CLASS_TABLE}) / (n + 1e-9) AS inv FROM {CLASS_TABLE})
SELECT label, CAST(n AS BIGINT) AS n, round(inv / (SELECT avg(inv) FROM t), 6) AS weight FROM t"""
WEIGHTS_SUM = f"""WITH t AS (SELECT label, n, 1.0 / greatest(n, 1) AS w FROM {CLASS_TABLE})
SELECT label, CAST(n AS BIGINT) AS n, round(w / (SELECT sum(w) FROM t), 6) AS weight FROM t"""

_RANKED = """WITH d AS (SELECT l.doc_id, l.quality AS label FROM labels l JOIN documents USING (doc_id)),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM d)"""
SPLIT = _RANKED + """
SELECT doc_id, label, CASE WHEN rk * 10 <= 8 * n THEN 'train' WHEN rk * 10 <= 9 * n THEN 'validation' ELSE 'test' END AS split FROM r"""
CARVE = _RANKED + """
SELECT doc_id, label, CASE WHEN rk <= n - floor((n * 1111 + 9999) / 10000) THEN 'train' ELSE 'validation' END AS split FROM r"""

EARLY = """WITH e AS (SELECT event_type, event_id, value,
   row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step,
   max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
   FROM events),
f AS (SELECT *, max(CASE WHEN pb IS NULL OR value > pb THEN step END)
   OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM e)
SELECT event_type, count(*) AS n_evals, CAST(min(CASE WHEN step - li >= 3 THEN step END) AS BIGINT) AS stop_step,
       min(CASE WHEN step - li >= 3 THEN event_id END) AS stop_event_id FROM f GROUP BY event_type"""

BEST = """SELECT event_type, first(event_id ORDER BY value DESC, event_id) AS best_event_id, max(value) AS best_value
FROM events GROUP BY event_type"""

SQL.update({
    "normalize_gold": f"SELECT source, raw, {gold_label('raw')} AS gold, count(*) AS n FROM {RAW_LABELS} GROUP BY ALL",
    "normalize_3class": (f"SELECT source, raw, label3, CAST(CASE label3 " +
                         " ".join(f"WHEN {q(v)} THEN {i}" for i, v in enumerate(vocab.THREE_CLASS_LABELS)) +
                         f" END AS BIGINT) AS label_id, count(*) AS n FROM (SELECT source, raw, {three_class('raw')} AS label3 "
                         f"FROM {RAW_LABELS}) GROUP BY ALL"),
    "normalize_binary": f"SELECT source, raw, CAST({binary_label('raw')} AS BIGINT) AS label2, count(*) AS n FROM {RAW_LABELS} GROUP BY ALL",
    "confusion_counts": CONF_COUNTS,
    "confusion_normalized": CONF_NORM,
    "class_report": CLASS_REPORT,
    "macro_metrics": MACRO,
    "binary_metrics": BINARY,
    "class_weights_mean": WEIGHTS_MEAN,
    "class_weights_sum": WEIGHTS_SUM,
    "stratified_split": SPLIT,
    "stratified_carveout": CARVE,
    "early_stop": EARLY,
    "best_checkpoint": BEST,
})


# ---------------------------------------------------------------- keywords and scoreboard
def bucket(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % 64)"


def embed_kw_sql(src: str, keys: list, text: str, n_max: int, top_n: int, stop_lang: str = "english") -> str:
    """Self-contained subquery ``<keys..., rank, keyword, score>``."""
    k = ", ".join(keys)
    on = " AND ".join(f"gb.{c} = dv.{c}" for c in keys)
    grams = ", ".join(f"list_transform(range(0, len(ft) - {n} + 1), lambda i: ft[i + 1:i + {n}])"
                      for n in range(1, n_max + 1))
    return f"""(WITH tk AS (SELECT {k}, {tokens(text)} AS toks FROM {src}),
dv AS (SELECT {k}, {bucket('t')} AS b, count(*) AS dv FROM (SELECT {k}, unnest(toks) AS t FROM tk) GROUP BY ALL),
dn AS (SELECT {k}, sqrt(sum(dv * dv)) AS dnorm FROM dv GROUP BY ALL),
ft AS (SELECT {k}, {no_stop('toks', stop_lang)} AS ft FROM tk),
gr AS (SELECT DISTINCT {k}, g FROM (SELECT {k}, unnest(flatten([{grams}])) AS g FROM ft)),
gb AS (SELECT {k}, gram, {bucket('t')} AS b, count(*) AS cv
       FROM (SELECT {k}, array_to_string(g, ' ') AS gram, unnest(g) AS t FROM gr) GROUP BY ALL),
sc AS (SELECT {", ".join("gb." + c for c in keys)}, gram, sum(cv * coalesce(dv.dv, 0)) AS dot, sum(cv * cv) AS cn
       FROM gb LEFT JOIN dv ON {on} AND gb.b = dv.b GROUP BY ALL),
rk AS (SELECT sc.*, round(dot / (sqrt(cn) * dnorm), 6) AS score FROM sc JOIN dn USING ({k})),
rn AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, gram) AS rank FROM rk)
SELECT {k}, CAST(rank AS BIGINT) AS rank, gram AS keyword, score FROM rn WHERE rank <= {top_n})"""


def share(x: str) -> str:
    p = clause_parts(x)
    return (f"(SELECT CASE WHEN len(_p) = 0 THEN 0.0 ELSE len(list_filter(_p, lambda z: regexp_matches(z, '\\d'))) "
            f"/ len(_p) END FROM (SELECT {p} AS _p))")


def jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)"


def board_ctes() -> str:
    """CTEs ending in ``board`` (the scoreboard) and ``pr``/``sim``."""
    return tfidf_summary_ctes() + f""",
sm AS (SELECT 'lead-3' AS modelo, 0 AS method_idx, doc_id, array_to_string(sents[1:3], ' ') AS summary FROM d
       UNION ALL SELECT 'tfidf-top5', 1, doc_id, summary FROM ts
       UNION ALL SELECT '''que''', 2, doc_id, array_to_string({after_que_parts('text')}, ' ') FROM documents),
pr AS (SELECT sm.modelo, sm.method_idx, sm.doc_id, sm.summary, documents.text AS original
       FROM sm JOIN documents USING (doc_id)),
ca AS (SELECT modelo, doc_id, term, count(*) AS a
       FROM (SELECT modelo, doc_id, unnest({no_stop(tokens('original'))}) AS term FROM pr) GROUP BY ALL),
cb AS (SELECT modelo, doc_id, term, count(*) AS b
       FROM (SELECT modelo, doc_id, unnest({no_stop(tokens('summary'))}) AS term FROM pr) GROUP BY ALL),
cj AS (SELECT coalesce(ca.modelo, cb.modelo) AS modelo, coalesce(ca.doc_id, cb.doc_id) AS doc_id,
              coalesce(ca.a, 0) AS a, coalesce(cb.b, 0) AS b
       FROM ca FULL OUTER JOIN cb ON ca.modelo = cb.modelo AND ca.doc_id = cb.doc_id AND ca.term = cb.term),
cs AS (SELECT modelo, doc_id, sum(a * b * f * f) AS dot, sum(a * a * f * f) AS na, sum(b * b * f * f) AS nb
       FROM (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE ln(1.5) + 1.0 END AS f FROM cj) GROUP BY ALL),
sim AS (SELECT modelo, doc_id,
               round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dot / (sqrt(na) * sqrt(nb)) END, 6) AS sim_tfidf FROM cs),
ko AS (SELECT doc_id, list_distinct(list(lower(keyword))) AS kw_o
       FROM {embed_kw_sql('documents', ['doc_id'], 'text', 1, 5)} GROUP BY ALL),
ks AS (SELECT modelo, doc_id, list_distinct(list(lower(keyword))) AS kw_s
       FROM {embed_kw_sql('pr', ['modelo', 'doc_id'], 'summary', 1, 5)} GROUP BY ALL),
board AS (
  SELECT pr.modelo, pr.doc_id AS idx_texto, pr.method_idx, CAST(0.0 AS DOUBLE) AS tempo_s,
         round(length(pr.summary) / greatest(length(pr.original), 1), 6) AS compression_ratio,
         sim.sim_tfidf,
         round({jaccard('coalesce(ko.kw_o, [])', 'coalesce(ks.kw_s, [])')}, 6) AS jaccard_kw,
         round({share('pr.summary')}, 6) AS factual_share,
         CAST(length(pr.summary) AS BIGINT) AS len_texto
  FROM pr LEFT JOIN sim USING (modelo, doc_id) LEFT JOIN ko USING (doc_id) LEFT JOIN ks USING (modelo, doc_id)
  UNION ALL
  SELECT 'Original', doc_id, -1, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE), round({share('text')}, 6), CAST(length(text) AS BIGINT)
  FROM documents)"""


BOARD_COLS = "modelo, idx_texto, tempo_s, compression_ratio, sim_tfidf, jaccard_kw, factual_share, len_texto"
BY_MODEL = """SELECT modelo, round(avg(tempo_s), 6) AS tempo_medio_s, round(avg(compression_ratio), 6) AS compression_ratio_medio,
  round(avg(sim_tfidf), 6) AS sim_tfidf_medio, round(avg(jaccard_kw), 6) AS jaccard_kw_medio,
  round(avg(factual_share), 6) AS factual_share_medio FROM board GROUP BY modelo"""
RADAR_COLS = ["sim_tfidf_medio", "jaccard_kw_medio", "factual_share_medio", "compression_ratio_medio", "tempo_medio_s"]


def radar_sql(variant: str, where: str) -> str:
    cols = []
    for c in RADAR_COLS:
        s = f"({c} - (SELECT min({c}) FROM a{variant})) / ((SELECT max({c}) FROM a{variant}) - (SELECT min({c}) FROM a{variant}) + 1e-9)"
        cols.append(f"round({'1 - ' if c == 'tempo_medio_s' else ''}{s}, 6) AS {c}")
    return f"SELECT '{variant}' AS variant, modelo, {', '.join(cols)} FROM a{variant}"


METRICS = ["tempo_s", "compression_ratio", "sim_tfidf", "jaccard_kw", "factual_share"]
PER_TEXT = ("SELECT idx_texto, modelo, CAST(CASE WHEN modelo = 'Original' THEN 0 ELSE method_idx + 1 END AS BIGINT) AS model_order, "
            "metric, value FROM (SELECT idx_texto, modelo, method_idx, unnest([" +
            ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in ["len_texto"] + METRICS) +
            "], recursive := true) FROM board)")
BOX = f"""v AS (SELECT modelo, metric, value FROM ({PER_TEXT}) WHERE metric <> 'len_texto' AND value IS NOT NULL),
bs AS (SELECT modelo, metric, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1,
              quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY ALL),
bx AS (SELECT bs.modelo, bs.metric, max(v.value) FILTER (WHERE v.value <= bs.q3 + 1.5 * (bs.q3 - bs.q1)) AS mhi,
              min(v.value) FILTER (WHERE v.value >= bs.q1 - 1.5 * (bs.q3 - bs.q1)) AS mlo
       FROM bs JOIN v USING (modelo, metric) GROUP BY bs.modelo, bs.metric),
bw AS (SELECT bs.*, coalesce(greatest(bx.mhi, bs.q3), bs.q3) AS whishi, coalesce(least(bx.mlo, bs.q1), bs.q1) AS whislo
       FROM bs JOIN bx USING (modelo, metric)),
bo AS (SELECT bw.modelo, bw.metric, count(*) FILTER (WHERE v.value < bw.whislo OR v.value > bw.whishi) AS n_outliers
       FROM bw JOIN v USING (modelo, metric) GROUP BY ALL)
SELECT modelo, metric, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(whislo, 6) AS whislo, round(whishi, 6) AS whishi, CAST(n_outliers AS BIGINT) AS n_outliers
FROM bw JOIN bo USING (modelo, metric)"""

WORDS = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^{WS}\p{{L}}\p{{M}}\p{{N}}_]"
FREQ_KW = f"""WITH w AS (SELECT doc_id, CAST(generate_subscripts(_w, 1) - 1 AS BIGINT) AS pos, lower(unnest(_w)) AS term
  FROM (SELECT doc_id, regexp_extract_all(text, {q(WORDS)}) AS _w FROM documents)),
f AS (SELECT doc_id, term, count(*) AS cnt, min(pos) AS first_pos FROM w
      WHERE regexp_full_match(term, '\\p{{L}}+') AND NOT list_contains({stop_list()}, term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS rank FROM f)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, term, cnt FROM r WHERE rank <= 10"""

TFIDF_KW = f"""WITH t AS (SELECT doc_id, unnest({no_stop(tokens('text'))}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT *, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, term, score FROM r WHERE rank <= 10"""


def keyword_set(x: str) -> str:
    return (f"list_distinct(list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[;,|/\\n]+'), "
            f"lambda p: lower({strip('p')})), lambda p: p <> ''))")


KW_JACCARD = ("WITH " + board_ctes() + f""",
hk AS (SELECT item_id AS doc_id, {keyword_set('text')} AS kw FROM benchmark
       WHERE item_id IN (SELECT item_id FROM benchmark GROUP BY item_id HAVING count(*) = 1)),
kr AS (SELECT modelo, doc_id, list_distinct(list(lower(keyword))) AS kw
       FROM {embed_kw_sql('pr', ['modelo', 'doc_id'], 'summary', 3, 10)} GROUP BY ALL),
j AS (SELECT pr.modelo, pr.doc_id, coalesce(hk.kw, []) AS ko, coalesce(kr.kw, []) AS kr
      FROM pr LEFT JOIN hk USING (doc_id) LEFT JOIN kr USING (modelo, doc_id))
SELECT modelo, doc_id AS idx_texto, round({jaccard('ko', 'kr')}, 6) AS jaccard_kw,
       coalesce(array_to_string(list_sort(ko), '; '), '') AS kw_orig,
       coalesce(array_to_string(list_sort(kr), '; '), '') AS kw_resumo FROM j""")

SQL.update({
    "freq_keywords": FREQ_KW,
    "tfidf_keywords": TFIDF_KW,
    "ngram_keywords": "SELECT * FROM " + embed_kw_sql("documents", ["doc_id"], "text", 3, 10),
    "doc_summary_cosine": "WITH " + board_ctes() + "\nSELECT pr.modelo, pr.doc_id, sim.sim_tfidf AS cosine FROM pr LEFT JOIN sim USING (modelo, doc_id)",
    "keyword_jaccard": KW_JACCARD,
    "scoreboard": "WITH " + board_ctes() + f"\nSELECT {BOARD_COLS} FROM board",
    "scoreboard_by_model": "WITH " + board_ctes() + "\n" + BY_MODEL,
    "radar": ("WITH " + board_ctes() + f",\nawith_baseline AS ({BY_MODEL}),\namodels AS (SELECT * FROM awith_baseline WHERE modelo <> 'Original')\n"
              + radar_sql("with_baseline", "") + "\nUNION ALL\n" + radar_sql("models", "")),
    "boxplot_stats": "WITH " + board_ctes() + ",\n" + BOX,
    "per_text_compare": "WITH " + board_ctes() + "\n" + PER_TEXT,
    "tradeoff": ("WITH " + board_ctes() + "\nSELECT 'sim_tfidf_vs_compression_ratio' AS pair, modelo, idx_texto, compression_ratio AS x, sim_tfidf AS y FROM board"
                 "\nUNION ALL SELECT 'sim_tfidf_vs_tempo_s', modelo, idx_texto, tempo_s, sim_tfidf FROM board"),
    "factual_share": f"SELECT doc_id, CAST(len({clause_parts('text')}) AS BIGINT) AS n_segments, "
                     f"CAST(len(list_filter({clause_parts('text')}, lambda z: regexp_matches(z, '\\d'))) AS BIGINT) AS n_factual, "
                     f"{share('text')} AS factual_share FROM documents",
    "factual_segments": f"SELECT doc_id, CAST(len(_f) AS BIGINT) AS n_factual, array_to_string(_f, ' | ') AS factual_text "
                        f"FROM (SELECT doc_id, list_filter({clause_parts('text')}, lambda z: regexp_matches(z, '\\d')) AS _f FROM documents)",
})


# ---------------------------------------------------------------- similarity, word pieces, tagger
SIM_SEG = """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v,
   lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS nx,
   row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
s AS (SELECT *, list_dot_product(v, nx) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(nx, nx))) AS sim FROM e),
t AS (SELECT label, avg(sim) - stddev_pop(sim) AS thr FROM s GROUP BY label),
f AS (SELECT s.*, coalesce(CAST(sim < thr AS BIGINT), 0) AS brk FROM s JOIN t USING (label))
SELECT label, vec_id, CAST(pos AS BIGINT) AS pos, round(sim, 6) AS sim,
  CAST(sum(brk) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - brk AS BIGINT) AS segment FROM f"""

WORDPIECE = f"""WITH p AS (SELECT doc_id, CAST(generate_subscripts(_w, 1) - 1 AS BIGINT) AS pos, unnest(_w) AS tok
  FROM (SELECT doc_id, regexp_extract_all(text, {q(WORDS)}) AS _w FROM documents)),
g AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 2 THEN '##' || tok ELSE tok END AS piece FROM p),
h AS (SELECT *, (NOT starts_with(piece, '##') OR pos = 0) AS st FROM g),
k AS (SELECT *, sum(CAST(st AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM h),
w AS (SELECT doc_id, grp, string_agg(CASE WHEN st THEN piece ELSE substr(piece, 3) END, '' ORDER BY pos) AS word FROM k GROUP BY ALL)
SELECT doc_id, count(*) AS n_words, string_agg(word, ' ' ORDER BY grp) AS text FROM w GROUP BY doc_id"""


def tagger_ctes() -> str:
    st = stop_list()
    return f"""
sd AS (SELECT doc_id, unnest(sents) AS sentence, CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS sid
       FROM (SELECT doc_id, {sentences('text')} AS sents FROM documents)),
tk AS (SELECT doc_id, sid, CAST(generate_subscripts(_w, 1) - 1 AS BIGINT) AS pos, unnest(_w) AS word
       FROM (SELECT doc_id, sid, regexp_extract_all(sentence, {q(WORDS)}) AS _w FROM sd)),
gt AS (SELECT *, CASE WHEN regexp_full_match(word, '\\p{{N}}+') THEN 'NUM'
                      WHEN NOT regexp_matches(word, '[\\p{{L}}\\p{{N}}_]') THEN 'PU'
                      WHEN list_contains({st}, lower(word)) THEN 'ART'
                      WHEN regexp_matches(word, 'mente$') THEN 'ADV'
                      WHEN regexp_matches(word, '(ar|er|ir)$') THEN 'V'
                      WHEN regexp_matches(word, '(al|vel|oso|osa|ivo|iva)$') THEN 'ADJ'
                      WHEN pos > 0 AND regexp_matches(word, '^\\p{{Lu}}') THEN 'NPROP'
                      ELSE 'N' END AS tag FROM tk),
uc AS (SELECT word, tag, count(*) AS n FROM gt GROUP BY ALL),
uni AS (SELECT word, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS r FROM uc) WHERE r = 1),
cx AS (SELECT gt.*, coalesce(lag(tag) OVER (PARTITION BY doc_id, sid ORDER BY pos), '<S>') AS prev_tag FROM gt),
us AS (SELECT cx.prev_tag, cx.word FROM cx LEFT JOIN uni ON uni.word = cx.word GROUP BY cx.prev_tag, cx.word
       HAVING max(CASE WHEN cx.tag <> coalesce(uni.tag, '') THEN 1 ELSE 0 END) = 1),
bc AS (SELECT prev_tag, word, tag, count(*) AS n FROM cx GROUP BY ALL),
bi AS (SELECT prev_tag, word, tag, n FROM (SELECT bc.*, row_number() OVER (PARTITION BY bc.prev_tag, bc.word ORDER BY n DESC, tag) AS r
       FROM bc JOIN us USING (prev_tag, word)) WHERE r = 1),
bm AS (SELECT word, map_from_entries(list({{'k': prev_tag, 'v': tag}})) AS m FROM bi GROUP BY word),
tm AS (SELECT tk.doc_id, tk.sid, tk.pos, tk.word, uni.tag AS utag, bm.m AS bmap
       FROM tk LEFT JOIN uni USING (word) LEFT JOIN bm USING (word)),
ts AS (SELECT doc_id, sid, count(*) AS n_tokens, list(word ORDER BY pos) AS words,
              list({{'utag': utag, 'bmap': bmap}} ORDER BY pos) AS xs FROM tm GROUP BY ALL),
tg AS (SELECT doc_id, sid, n_tokens, words, ltrim(list_reduce(xs, lambda acc, x: acc || ' ' || coalesce(coalesce(
          x.bmap[CASE WHEN acc = '' OR regexp_extract(acc, '(\\S+)$', 1) = '-' THEN '<S>'
                      ELSE regexp_extract(acc, '(\\S+)$', 1) END], x.utag), '-'), ''), ' ') AS tags FROM ts)"""


NOUN_PHRASES = "WITH " + tagger_ctes() + f""",
tt AS (SELECT doc_id, sid, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS pos, unnest(words) AS word,
              unnest(string_split(tags, ' ')) AS tag FROM tg),
np AS (SELECT *, coalesce(tag IN ('N', 'NPROP', 'ADJ') AND NOT list_contains({stop_list()}, lower(word)), false) AS inside FROM tt),
il AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sid ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM np)
SELECT doc_id, sid, min(pos) AS start, string_agg(word, ' ' ORDER BY pos) AS phrase FROM il WHERE inside GROUP BY doc_id, sid, island"""

SQL.update({
    "similarity_segments": SIM_SEG,
    "wordpiece_rejoin": WORDPIECE,
    "pos_train": "WITH " + tagger_ctes() + "\nSELECT 'unigram' AS kind, CAST(NULL AS VARCHAR) AS prev_tag, word, tag, n FROM uni"
                 "\nUNION ALL SELECT 'bigram', prev_tag, word, tag, n FROM bi",
    "pos_tag": "WITH " + tagger_ctes() + "\nSELECT doc_id, sid, CAST(n_tokens AS BIGINT) AS n_tokens, tags FROM tg",
    "noun_phrases": NOUN_PHRASES,
})


# ---------------------------------------------------------------- cells, columns, translation
INFER_COLS = {"documents": "text", "benchmark": "text", "conversations": "text", "pages": "url"}
INFER = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS text_col, count(*) AS n_rows, "
    f"sum(CASE WHEN length({strip(c)}) > 0 THEN 1 ELSE 0 END) AS n_nonblank, "
    f"CAST(sum(length({c})) AS BIGINT) AS n_chars FROM {t}" for t, c in INFER_COLS.items())


def list_literal(arr: str) -> str:
    from factlake.functions.text import LITERAL_ESCAPES
    item = "x"
    for a, b in LITERAL_ESCAPES:
        item = f"replace({item}, {q(a)}, {q(b)})"
    return f"('[' || array_to_string(list_transform({arr}, lambda x: '''' || {item} || ''''), ', ') || ']')"


CELLS = (f"(SELECT doc_id, lang, text, CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN text "
         f"ELSE {list_literal(after_que_parts('text'))} END AS cell, "
         f"CASE WHEN lang NOT IN ('de', 'es') THEN array_to_string({after_que_parts('text')}, ' ') END AS joined FROM documents)")


def first_nonblank(*cols) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(c)}, '')" for c in cols) + ", '')"


TRANSLATE = f"""WITH lx AS (SELECT DISTINCT unnest({tokens('text')}) AS src FROM benchmark),
ch AS (SELECT doc_id, CAST(generate_subscripts(_c, 1) - 1 AS BIGINT) AS chunk_id, unnest(_c) AS chunk
       FROM (SELECT doc_id, {chunks('text')} AS _c FROM documents)),
pc AS (SELECT doc_id, chunk_id, CAST(generate_subscripts(_p, 1) - 1 AS BIGINT) AS pos, unnest(_p) AS piece
       FROM (SELECT doc_id, chunk_id, string_split(chunk, ' ') AS _p FROM ch)),
tr AS (SELECT pc.doc_id, pc.chunk_id, pc.pos, coalesce(reverse(lx.src), pc.piece) AS piece
       FROM pc LEFT JOIN lx ON lower(pc.piece) = lx.src),
cj AS (SELECT doc_id, chunk_id, string_agg(piece, ' ' ORDER BY pos) AS chunk FROM tr GROUP BY ALL),
dj AS (SELECT doc_id, string_agg(chunk, ' ' ORDER BY chunk_id) AS t FROM cj GROUP BY ALL)
SELECT documents.doc_id, {strip("coalesce(dj.t, '')")} AS text_pt FROM documents LEFT JOIN dj USING (doc_id)"""

_PRIMARY = "CASE WHEN lang = 'en' THEN text END"
_FALLBACK = "CASE WHEN lang <> 'de' THEN source END"
COALESCE_TEXT = f"SELECT doc_id, {first_nonblank(_PRIMARY, _FALLBACK)} AS text FROM documents"
_BRACKETS = r"regexp_replace(cell, '[\[\]'']', '', 'g')"
CLEAN_CELLS = f"SELECT doc_id, {strip(_BRACKETS)} AS text FROM {CELLS}"

SQL.update({
    "infer_text_column": INFER,
    "coalesce_text": COALESCE_TEXT,
    "list_cell_text": f"SELECT doc_id, CASE WHEN lang = 'de' THEN '' WHEN lang = 'es' THEN text ELSE joined END AS text FROM {CELLS}",
    "clean_list_cells": CLEAN_CELLS,
    "lexicon_translate": TRANSLATE,
})


def tfidf_kw_sql(src: str, text: str, k: int = 10) -> str:
    return f"""(WITH t AS (SELECT doc_id, unnest({no_stop(tokens(text))}) AS term FROM {src}),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT *, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s)
SELECT doc_id, rank, term, score FROM r WHERE rank <= {k})"""


NEWS = "WITH " + tfidf_summary_ctes() + f""",
kt AS (SELECT doc_id, string_agg(term, ', ' ORDER BY rank) AS kw FROM {tfidf_kw_sql('ts', 'summary')} GROUP BY doc_id),
ke AS (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS kw FROM {embed_kw_sql('ts', ['doc_id'], 'summary', 1, 5)} GROUP BY doc_id),
qd AS (SELECT doc_id, {list_literal(after_que_parts('text'))} AS termos_relevantes FROM documents)
SELECT ts.doc_id, ts.summary AS resumo, coalesce(kt.kw, '') AS palavras_chave_tfidf,
       coalesce(ke.kw, '') AS palavras_chave_emb, qd.termos_relevantes
FROM ts LEFT JOIN kt USING (doc_id) LEFT JOIN ke USING (doc_id) JOIN qd USING (doc_id)"""
SQL["news_record"] = NEWS
_LINE = strip("translate(text, chr(10) || chr(13), '  ')")
SQL["source_roundtrip"] = f"""SELECT source, value, count(*) AS n FROM (
SELECT 'csv' AS source, concat_ws(',', doc_id, quality, toxic) AS value FROM labels
UNION ALL SELECT 'lines', md5({_LINE}) FROM documents) GROUP BY ALL"""
SQL["classify_model"] = ("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]') THEN 'factual' ELSE 'non-factual' END AS label, "
                         "CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")

_BUNDLE_TFIDF = tfidf_kw_sql("jt", "unido")
SQL["keyword_bundle"] = "WITH " + tagger_ctes() + f""",
tt AS (SELECT doc_id, sid, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS pos, unnest(words) AS word,
              unnest(string_split(tags, ' ')) AS tag FROM tg),
np AS (SELECT *, coalesce(tag IN ('N', 'NPROP', 'ADJ') AND NOT list_contains({stop_list()}, lower(word)), false) AS inside FROM tt),
il AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sid ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM np),
ph AS (SELECT doc_id, sid, min(pos) AS start, string_agg(word, ' ' ORDER BY pos) AS phrase FROM il WHERE inside GROUP BY doc_id, sid, island),
pd AS (SELECT doc_id, string_agg(phrase, '; ' ORDER BY sid, start) AS noun_phrases, string_agg(phrase, ' ' ORDER BY sid, start) AS j FROM ph GROUP BY doc_id),
jt AS (SELECT documents.doc_id, coalesce(pd.j, documents.text) AS unido FROM documents LEFT JOIN pd USING (doc_id)),
kt AS (SELECT doc_id, string_agg(term, '; ' ORDER BY rank) AS kw FROM {_BUNDLE_TFIDF} GROUP BY doc_id),
kf AS (SELECT doc_id, string_agg(term, '; ' ORDER BY rank) AS kw FROM ({FREQ_KW}) GROUP BY doc_id),
ke AS (SELECT doc_id, string_agg(keyword, '; ' ORDER BY rank) AS kw FROM {embed_kw_sql('documents', ['doc_id'], 'text', 1, 5)} GROUP BY doc_id)
SELECT documents.doc_id, coalesce(pd.noun_phrases, '') AS noun_phrases, coalesce(kf.kw, '') AS frequent_words,
       coalesce(kt.kw, '') AS tfidf_words, coalesce(ke.kw, '') AS embedding_words
FROM documents LEFT JOIN pd USING (doc_id) LEFT JOIN kf USING (doc_id) LEFT JOIN kt USING (doc_id) LEFT JOIN ke USING (doc_id)"""

CLAIM_GP = (f"(SELECT {gold_label('CAST(quality AS VARCHAR)')} AS gold, "
            f"CASE WHEN regexp_matches(text, '\\d') THEN 'factual' ELSE 'non-factual' END AS pred "
            f"FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL)")
SQL["claim_eval_report"] = CLASS_REPORT.replace(f"FROM {GOLD_PRED} GROUP BY ALL",
                                                f"FROM (SELECT * FROM {CLAIM_GP} WHERE gold IS NOT NULL) GROUP BY ALL")

# ---------------------------------------------------------------- pluggable models
LEXICON = f"""bt AS (SELECT item_id, {tokens('text')} AS w FROM benchmark),
ps AS (SELECT a.w AS s, b.w AS t, unnest(range(1, least(len(a.w), len(b.w)) + 1)) AS i FROM bt a JOIN bt b ON b.item_id = a.item_id + 1),
pn AS (SELECT s[i] AS src, t[i] AS tgt, count(*) AS n FROM ps GROUP BY ALL),
lx AS (SELECT src, first(tgt ORDER BY n DESC, tgt) AS tgt FROM pn GROUP BY src)"""
SQL["aligned_lexicon"] = f"WITH {LEXICON} SELECT src, tgt FROM lx"
SQL["translate_model"] = TRANSLATE.replace(f"lx AS (SELECT DISTINCT unnest({tokens('text')}) AS src FROM benchmark)", LEXICON).replace(
    "coalesce(reverse(lx.src), pc.piece)", "coalesce(lx.tgt, pc.piece)")
SQL["ngram_keywords_model"] = SQL["ngram_keywords"]
SQL["quarantine"] = """SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '[0-9]+'), '') AS value,
  CASE WHEN NOT regexp_matches(coalesce(text, ''), '[0-9]') THEN 'ValueError: no number in the text' END AS error FROM documents"""
SQL["link_texts"] = f"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*', '', 's') AS a, {page_text('html')} AS t FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY page_id) AS r FROM p)
SELECT p.page_id AS link_id, p.a || '#end' AS url, f.page_id, f.t AS text FROM p LEFT JOIN f ON p.a = f.a AND f.r = 1"""
SQL["category_order"] = """SELECT lang, source, min(doc_id) AS first,
row_number() OVER (PARTITION BY lang ORDER BY min(doc_id), source) AS position FROM documents GROUP BY lang, source"""

# ---------------------------------------------------------------- word pieces, claims between breaks
SQL["subword_limit"] = f"""WITH RECURSIVE tk AS (SELECT doc_id, unnest(_w) AS word, generate_subscripts(_w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), {q(WORDS)}) AS _w FROM documents)),
bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {q(WORDS)})) AS w FROM benchmark),
vc AS (SELECT DISTINCT unnest(list_concat([w], list_transform(range(1, 5), lambda k: substr(w, 1, k)),
    list_transform(range(1, least(length(w), 4) + 1), lambda k: '##' || substr(w, length(w) - k + 1, k)),
    list_transform(range(1, length(w) + 1), lambda i: '##' || substr(w, i, 1)))) AS piece FROM bw),
wd AS (SELECT DISTINCT word FROM tk),
pl AS (SELECT word, unnest(range(1, length(word) + 1)) AS start FROM wd),
sp AS (SELECT word, start, unnest(range(1, length(word) - start + 2)) AS n FROM pl),
bt AS (SELECT word, start, max(n) AS n FROM sp JOIN vc ON piece = (CASE WHEN start > 1 THEN '##' ELSE '' END) || substr(word, start, n) GROUP BY ALL),
wk(word, start, ps) AS (SELECT word, CAST(1 AS BIGINT), CAST([] AS VARCHAR[]) FROM wd
  UNION ALL SELECT wk.word, wk.start + bt.n, list_append(wk.ps, (CASE WHEN wk.start > 1 THEN '##' ELSE '' END) || substr(wk.word, wk.start, bt.n))
  FROM wk JOIN bt ON wk.word = bt.word AND wk.start = bt.start),
pc AS (SELECT wd.word, coalesce(wk.ps, ['[UNK]']) AS ps FROM wd LEFT JOIN wk ON wk.word = wd.word AND wk.start = length(wd.word) + 1),
dc AS (SELECT doc_id, flatten(list(ps ORDER BY pos)) AS ps FROM tk JOIN pc USING (word) GROUP BY doc_id),
al AS (SELECT d.doc_id, coalesce(dc.ps, []) AS ps FROM documents d LEFT JOIN dc USING (doc_id)),
ct AS (SELECT doc_id, len(ps) AS n_pieces, len(list_filter(ps, lambda x: x = '[UNK]')) AS n_unknown,
  replace(array_to_string(ps[1:128], ' '), ' ##', '') AS cut FROM al)
SELECT doc_id, CAST(n_pieces AS BIGINT) AS n_pieces, CAST(n_unknown AS BIGINT) AS n_unknown, cut,
  CASE WHEN regexp_matches(cut, '[0-9]') THEN 'factual' ELSE 'non-factual' END AS label FROM ct"""
SQL["factual_pieces"] = f"""WITH sd AS (SELECT doc_id, unnest(sents) AS sentence, CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS sid
  FROM (SELECT doc_id, {sentences('text')} AS sents FROM documents)),
tm AS (SELECT doc_id, sid, term, count(*) AS tf FROM (SELECT doc_id, sid, unnest({tokens('sentence')}) AS term FROM sd) GROUP BY ALL),
nm AS (SELECT doc_id, sid, sum(tf * tf) AS nn FROM tm GROUP BY ALL),
dt AS (SELECT a.doc_id, a.sid, sum(a.tf * b.tf) AS dot FROM tm a JOIN tm b ON a.doc_id = b.doc_id AND b.sid = a.sid + 1 AND a.term = b.term GROUP BY ALL),
jn AS (SELECT sd.doc_id, sd.sid, sd.sentence, lead(sd.sid) OVER (PARTITION BY sd.doc_id ORDER BY sd.sid) IS NULL AS at_end,
  CAST(floor(CAST(1000000 AS DOUBLE) * CAST(dot AS DOUBLE) / sqrt(CAST(a.nn * b.nn AS DOUBLE)) + 0.5) AS HUGEINT) AS c
  FROM sd LEFT JOIN nm a ON a.doc_id = sd.doc_id AND a.sid = sd.sid LEFT JOIN nm b ON b.doc_id = sd.doc_id AND b.sid = sd.sid + 1
  LEFT JOIN dt ON dt.doc_id = sd.doc_id AND dt.sid = sd.sid),
sm AS (SELECT *, CASE WHEN NOT at_end THEN coalesce(c, 0) END AS s FROM jn),
st AS (SELECT *, count(s) OVER p AS n, CAST(sum(s) OVER p AS HUGEINT) AS t, CAST(sum(s * s) OVER p AS HUGEINT) AS t2 FROM sm WINDOW p AS (PARTITION BY doc_id)),
br AS (SELECT *, CAST(coalesce(t - n * s > 0 AND (t - n * s) * (t - n * s) > n * t2 - t * t, false) AS BIGINT) AS b FROM st),
pi AS (SELECT doc_id, sid, sentence, coalesce(sum(b) OVER (PARTITION BY doc_id ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM br),
pt AS (SELECT doc_id, piece, string_agg(sentence, ' ' ORDER BY sid) AS text FROM pi GROUP BY ALL)
SELECT doc_id, count(*) AS n_pieces, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS n_factual,
  coalesce(string_agg(text, ' | ' ORDER BY piece) FILTER (WHERE regexp_matches(text, '[0-9]')), '') AS factual_text FROM pt GROUP BY doc_id"""
