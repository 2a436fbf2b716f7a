"""The registered queries once more, as SQL on the same tables.

Written against the tables from scratch: long form, window functions and list
functions, without sharing any expression with the Spark side.
"""

from __future__ import annotations

K = 500
PICKS = 10

LINE_TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG"]
TEXT_TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]
PREPOSITIONS = "('of', 'in', 'by', 'with', 'de')"
STOPS = "('the', 'and', 'of', 'in', 'to', 'is', 'on', 'that', 'it', 'an', 'for', 'with')"


def _u(seed: int, *ids: str) -> str:
    key = ", ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"((CAST('0x' || substr(md5(concat_ws(':', {key})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _names(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _softmax(x: str) -> str:
    return (f"list_transform({x}, lambda v: exp(v - list_max({x})) "
            f"/ list_sum(list_transform({x}, lambda w: exp(w - list_max({x})))))")


# --- shared inputs ----------------------------------------------------------

TOK = """tok AS (
  SELECT l_orderkey AS sid,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS tid,
    CASE l_returnflag WHEN 'N' THEN 'O' ELSE
      CASE WHEN l_linestatus = 'F' THEN 'B-' ELSE 'I-' END || CASE l_returnflag WHEN 'A' THEN 'PER' ELSE 'ORG' END
    END AS tag,
    [l_quantity / 10, l_discount * 40, l_tax * 50, l_extendedprice / 25000, (l_suppkey % 100)::DOUBLE / 20] AS logits
  FROM lineitem)"""
PRED = f"pred AS (SELECT sid, tid, tag, {_softmax('logits')} AS scores FROM tok)"
SORTED = "sorted AS (SELECT sid, tid, tag, scores, list_reverse_sort(scores) AS s FROM pred)"
ENTROPY = ("list_sum(list_transform(scores, lambda p: CASE WHEN p > 0 THEN "
           "-(p / list_sum(scores)) * ln(p / list_sum(scores)) ELSE 0 END))")
MEASURES = f"""measures AS (
  SELECT sid, tid, tag, {ENTROPY} AS entropy, s[1] - s[2] AS margin, s[1] AS confidence, s[5] AS lowest FROM sorted)"""
LAB = f"lab AS (SELECT sid, tid, tag FROM tok WHERE {_u(11, 'sid', 'tid')} < 0.2)"
SLAB = f"slab AS (SELECT sid, tid, tag FROM tok WHERE {_u(12, 'sid')} < 0.1)"
SEEDS = f"seeds AS (SELECT sid, tid FROM tok WHERE {_u(14, 'sid', 'tid')} < 0.02)"
MEASURED = [TOK, PRED, SORTED, MEASURES]

# One row per word of every line: position, part of speech and tag.
WORDS = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
split_lines AS (SELECT doc_id * 4294967296 + line_no AS sid, doc_id, line_no, regexp_extract_all(line, '[^ \\t\\r\\n]+') AS ws FROM lines),
listed AS (SELECT sid, doc_id, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tid FROM split_lines),
tagged AS (SELECT *, CASE WHEN lower(substr(word, 1, 1)) <> substr(word, 1, 1) THEN 'NNP'
    WHEN word IN {PREPOSITIONS} THEN 'IN' ELSE 'NN' END AS pos FROM listed),
words AS (SELECT *, CASE WHEN pos <> 'NNP' THEN 0
    WHEN lag(pos) OVER (PARTITION BY sid ORDER BY tid) = 'NNP' THEN length(word) % 3 * 2 + 2
    ELSE length(word) % 3 * 2 + 1 END AS tag_id FROM tagged)""".strip()
LOGIT = ", ".join(f"((length(word) * {7 * (c + 3)} + tid * {5 * (c + 1)}) % 17)::DOUBLE / 4" for c in range(7))
RAW = f"raw AS (SELECT sid, tid, word, tag_id, tid = 0 OR length(word) > 8 AS masked, [{LOGIT}] AS logits FROM words)"
AL = f"al AS (SELECT *, CASE WHEN {_u(13, 'sid', 'tid')} < 0.85 THEN tag_id ELSE -100 END AS al_tag FROM words)"


def _ranked(value: str, source: str, ids: str, where: str, k: int, down: bool = False) -> str:
    direction = "DESC" if down else "ASC"
    return (f"SELECT {ids}, round({value}, 9) AS score FROM {source} {where} "
            f"ORDER BY round({value}, 9) {direction}, {ids} LIMIT {k}")


def _race(u: str, margin: str) -> str:
    return f"round(ln(-ln({u})) + ln(greatest(round({margin}, 12), 1e-12)), 9)"


def _token_pick(strategy: str, k: int = K) -> str:
    where = "WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.sid = m.sid AND lab.tid = m.tid)"
    value, down = {
        "random": (_u(1, "sid", "tid"), False),
        "entropy": ("entropy", True),
        "breaking_ties": ("margin", False),
        "least_confidence": ("confidence", False),
        "stochastic_breaking_ties": (_race(_u(1, "sid", "tid"), "margin"), False),
    }[strategy]
    if strategy == "random":
        return f"SELECT sid, tid, {value} AS score FROM measures m {where} ORDER BY {value}, sid, tid LIMIT {k}"
    return _ranked(value, "measures m", "sid, tid", where, k, down)


SENTS = """sents AS (SELECT sid, max(entropy) AS entropy, min(margin) AS margin, min(confidence) AS confidence
  FROM measures GROUP BY sid)"""


def _sentence_pick(strategy: str) -> str:
    where = "WHERE sid NOT IN (SELECT sid FROM slab)"
    value, down = {
        "random": (_u(1, "sid"), False),
        "entropy": ("entropy", True),
        "breaking_ties": ("margin", False),
        "least_confidence": ("confidence", False),
        "stochastic_breaking_ties": (_race(_u(1, "sid"), "margin"), False),
    }[strategy]
    if strategy == "random":
        return f"SELECT sid, {value} AS score FROM sents {where} ORDER BY {value}, sid LIMIT {K}"
    return _ranked(value, "sents", "sid", where, K, down)


# Runs of entity tokens: a run number counts the tokens that open one.
def _runs(name: str, source: str, breaks: str) -> str:
    return f"""{name}_p AS (SELECT sid, tid, tag, lag(tag, 1, 'O') OVER (PARTITION BY sid ORDER BY tid) AS before FROM {source}),
{name}_n AS (SELECT sid, tid, tag, sum(CASE WHEN tag <> 'O' AND (before = 'O' OR {breaks}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY sid ORDER BY tid) AS run FROM {name}_p),
{name} AS (SELECT sid, min(tid) AS s, max(tid) + 1 AS e, arg_min(tag, tid) AS tag FROM {name}_n WHERE tag <> 'O' GROUP BY sid, run)"""


ANY_RUNS = _runs("anyrun", "tok", "FALSE")
BIO_BREAK = "tag[1] = 'B' OR tag[3:] <> before[3:]"
BIO_RUNS = _runs("biorun", "tok", BIO_BREAK)
EXPANDED = """expanded AS (
  SELECT DISTINCT t.sid, t.tid FROM picks p LEFT JOIN anyrun r ON r.sid = p.sid AND p.tid >= r.s AND p.tid < r.e
  JOIN tok t ON t.sid = p.sid AND t.tid >= coalesce(r.s, p.tid) AND t.tid < coalesce(r.e, p.tid + 1))"""
REVEALED = """revealed AS (
  SELECT t.sid, t.tid, t.tag FROM tok t WHERE (t.sid, t.tid) IN (SELECT sid, tid FROM lab UNION SELECT sid, tid FROM expanded))"""

EVENT_NAMES = [("click", "PAGE-CLICK"), ("error", "PAGE-ERROR"), ("purchase", "SHOP-PURCHASE"),
               ("signup", "SHOP-SIGNUP"), ("view", "O")]
_GOLD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES)
_WRONG = " ".join(f"WHEN '{k}' THEN '{EVENT_NAMES[(i + 1) % 5][1]}'" for i, (k, _) in enumerate(EVENT_NAMES))
PAIRS = f"""pairs AS (
  SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tid,
    CASE event_type {_GOLD} END AS gold,
    CASE WHEN {_u(15, 'event_id')} < 0.2 THEN CASE event_type {_WRONG} END ELSE CASE event_type {_GOLD} END END AS pred
  FROM events),
goldtok AS (SELECT sid, tid, gold AS tag FROM pairs),
predtok AS (SELECT sid, tid, pred AS tag FROM pairs)"""
IO = [PAIRS, _runs("goldrun", "goldtok", "tag <> before"), _runs("predrun", "predtok", "tag <> before")]
IO_COUNTS = """SELECT (SELECT count(*) FROM predrun) AS n_pred, (SELECT count(*) FROM goldrun) AS n_gold,
  (SELECT count(*) FROM goldrun JOIN predrun USING (sid, s, e, tag)) AS n_correct"""

CLASS = f"""class AS (SELECT vec_id AS id, {_softmax('x')} AS scores FROM
  (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 10) AS x FROM embeddings)),
csort AS (SELECT id, scores, list_reverse_sort(scores) AS s FROM class),
cm AS (SELECT id, {ENTROPY} AS entropy, s[1] - s[2] AS margin, s[1] AS confidence, list_min(scores) AS lowest FROM csort)"""

SPLIT = "CASE WHEN {0} % 10 < 8 THEN 'train' WHEN {0} % 10 = 8 THEN 'validation' ELSE 'test' END"


# --- text weights -----------------------------------------------------------

def _terms(ngrams: int, stops: bool) -> str:
    stop = f"WHERE term NOT IN {STOPS}" if stops else ""
    single = f"""single AS (SELECT sid, term, row_number() OVER (PARTITION BY sid ORDER BY i) AS i FROM (
    SELECT doc_id AS sid, unnest(x) AS term, generate_subscripts(x, 1) AS i FROM
      (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS x FROM documents)) {stop})"""
    if ngrams == 1:
        return single + ",\nterms AS (SELECT sid, term FROM single)"
    return single + """,
terms AS (SELECT sid, term FROM single UNION ALL
  SELECT a.sid, a.term || ' ' || b.term FROM single a JOIN single b ON a.sid = b.sid AND b.i = a.i + 1)"""


def _weights(ngrams: int, stops: bool, unit: bool = False) -> list[str]:
    ctes = [
        _terms(ngrams, stops),
        "tf AS (SELECT sid, term, count(*) AS tf FROM terms GROUP BY sid, term)",
        "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
        """plain AS (SELECT sid, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (df + 1)) + 1) AS w
  FROM tf JOIN df USING (term))""",
    ]
    if unit:
        ctes.append("weights AS (SELECT sid, term, w / sqrt(sum(w * w) OVER (PARTITION BY sid)) AS w FROM plain)")
    else:
        ctes.append("weights AS (SELECT sid, term, w FROM plain)")
    return ctes


TOPMEAN = """ranked AS (SELECT sid, w, row_number() OVER (PARTITION BY sid ORDER BY w DESC) AS r FROM weights),
means AS (SELECT sid, avg(w) AS m FROM ranked WHERE r <= 5 GROUP BY sid),
scored AS (SELECT doc_id AS sid, round(coalesce(m, 0), 9) AS score FROM documents LEFT JOIN means ON doc_id = sid)"""


def _greedy(ids: str, fresh: str, tie: str) -> str:
    """One table per pick: every pick rescores everything against the picks before it."""
    ctes = ["pick0 AS (SELECT 0 AS step, CAST(NULL AS BIGINT) AS sid, 0.0::DOUBLE AS score WHERE FALSE)"]
    for i in range(1, PICKS + 1):
        done = f"done{i}"
        ctes.append(f"{done} AS MATERIALIZED (SELECT * FROM pick{i - 1}" + (f" UNION ALL SELECT * FROM {f'done{i - 1}'})" if i > 1 else ")"))
        ctes.append(f"cnt{i} AS MATERIALIZED (SELECT term, count(*) AS c FROM gw WHERE sid IN (SELECT sid FROM {done}) GROUP BY term)")
        ctes.append(f"fresh{i} AS MATERIALIZED ({fresh.format(cnt=f'cnt{i}')})")
        ctes.append(f"""pick{i} AS MATERIALIZED (SELECT {i} AS step, d.sid, round(coalesce(f.score, 0), 9) AS score
  FROM ({ids}) d LEFT JOIN fresh{i} f ON f.sid = d.sid WHERE d.sid NOT IN (SELECT sid FROM {done})
  ORDER BY 3 DESC, {tie}, 2 LIMIT 1)""")
    return ",\n".join(ctes)


def _all_picks() -> str:
    return (f"SELECT step, sid, round(score, 6) AS score FROM "
            f"(SELECT * FROM done{PICKS} UNION ALL SELECT * FROM pick{PICKS})")


def _kmeans(farthest: bool, rounds: int = 4) -> str:
    """Spherical k-means with one set of tables for each round, then one table per pick."""
    ctes = [
        *_weights(1, True, True),
        "kw AS MATERIALIZED (SELECT sid, term, w FROM weights)",
        f"ids AS MATERIALIZED (SELECT doc_id AS sid, {_u(1, 'doc_id')} AS u FROM documents)",
        f"starts AS MATERIALIZED (SELECT sid, row_number() OVER (ORDER BY u, sid) - 1 AS c FROM ids ORDER BY u, sid LIMIT {PICKS})",
        "cen0 AS MATERIALIZED (SELECT c, term, w FROM kw JOIN starts USING (sid))",
    ]
    cosines = """SELECT i.sid, i.u, s.c, round(coalesce(d.dot, 0), 9) AS cos FROM ids i CROSS JOIN starts s
  LEFT JOIN (SELECT kw.sid, x.c, sum(kw.w * x.w) AS dot FROM kw JOIN cen{0} x USING (term) GROUP BY kw.sid, x.c) d ON d.sid = i.sid AND d.c = s.c"""
    for i in range(rounds):
        ctes += [
            f"cos{i} AS MATERIALIZED ({cosines.format(i)})",
            f"near{i} AS MATERIALIZED (SELECT sid, c FROM cos{i} QUALIFY row_number() OVER (PARTITION BY sid ORDER BY cos DESC, c) = 1)",
            f"sum{i} AS MATERIALIZED (SELECT c, term, sum(w) AS w FROM kw JOIN near{i} USING (sid) GROUP BY c, term)",
            f"len{i} AS MATERIALIZED (SELECT c, sqrt(sum(w * w)) AS len FROM sum{i} GROUP BY c)",
            f"""cen{i + 1} AS MATERIALIZED (SELECT c, term, round(w / len, 9) AS w FROM sum{i} JOIN len{i} USING (c)
  UNION ALL SELECT c, term, w FROM cen{i} WHERE c NOT IN (SELECT c FROM len{i}))""",
        ]
    tie = "CAST(floor(((u + c * 0.6180339887498949::DOUBLE) - floor(u + c * 0.6180339887498949::DOUBLE)) * 1048576) AS BIGINT)"
    ctes.append(f"keyed AS MATERIALIZED (SELECT sid, c, CAST(round((1 - cos) * 1e9) AS BIGINT) AS dist, {tie} AS tie FROM ({cosines.format(rounds)}))")
    ctes.append("p0 AS MATERIALIZED (SELECT 0 AS c, 0 AS sid, 0 AS dist WHERE FALSE)")
    for i in range(PICKS):
        ctes.append(f"""p{i + 1} AS MATERIALIZED (SELECT * FROM p{i} UNION ALL SELECT * FROM (SELECT c, sid, dist FROM keyed
  WHERE c = {i} AND sid NOT IN (SELECT sid FROM p{i}) ORDER BY dist {"DESC" if farthest else "ASC"}, tie, sid LIMIT 1))""")
    return _with(*ctes) + f"SELECT c::INTEGER AS cluster, sid::BIGINT AS sid, round(dist / 1e9::DOUBLE, 6) AS distance FROM p{PICKS}"


# --- training styles in long form ------------------------------------------

CANDS = r"""full_rows AS (SELECT sid, count(*) AS n, bool_and(al_tag <> -100) AS all_known FROM al GROUP BY sid),
letters AS (SELECT sid, regexp_replace(string_agg(CASE pos WHEN 'NNP' THEN 'N' WHEN 'IN' THEN 'I' ELSE 'O' END, '' ORDER BY tid),
    '(N+)I(N+)', '\1X\2', 'g') AS marks FROM al GROUP BY sid),
alin AS (SELECT al.*, substr(marks, tid + 1, 1) IN ('N', 'X') AS inside FROM al JOIN letters USING (sid)),
alrun AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY sid ORDER BY tid), FALSE) THEN 1 ELSE 0 END AS opens FROM alin),
alnum AS (SELECT *, sum(opens) OVER (PARTITION BY sid ORDER BY tid) - 1 AS no FROM alrun),
cands AS (SELECT sid, no, min(tid) AS s, max(tid) + 1 AS e, bool_and(al_tag <> -100) AS fully FROM alnum WHERE inside GROUP BY sid, no)"""

WINDOWS = """shape AS (SELECT f.sid, f.n, f.all_known, count(c.no) AS n_cands, coalesce(bool_and(c.fully), TRUE) AS all_full
  FROM full_rows f LEFT JOIN cands c USING (sid) GROUP BY f.sid, f.n, f.all_known),
kinds AS (SELECT *, CASE WHEN all_known OR n_cands = 0 THEN 'keep' WHEN n_cands = 1 OR all_full THEN 'close' ELSE 'split' END AS kind FROM shape),
wins AS (
  SELECT sid, kind, 0 AS no, 0 AS lo, n AS hi, 0 AS s, 0 AS e FROM kinds WHERE kind <> 'split'
  UNION ALL
  SELECT c.sid, k.kind, c.no,
    coalesce((SELECT max(o.e) FROM cands o WHERE o.sid = c.sid AND o.no < c.no AND NOT o.fully), 0),
    coalesce((SELECT min(o.s) FROM cands o WHERE o.sid = c.sid AND o.no > c.no AND NOT o.fully), k.n), c.s, c.e
  FROM cands c JOIN kinds k ON k.sid = c.sid WHERE k.kind = 'split'),
win_words AS (SELECT w.sid, w.no, a.tid, a.word, CASE WHEN a.al_tag <> -100 OR w.kind = 'keep' THEN a.al_tag
    WHEN w.kind = 'close' OR a.tid < w.s OR a.tid >= w.e THEN 0 ELSE -100 END AS t
  FROM wins w JOIN al a ON a.sid = w.sid AND a.tid >= w.lo AND a.tid < w.hi)"""


def _train(tag: str, keep: str = "TRUE") -> str:
    return (f"SELECT sid, 0 AS window_no, string_agg(word, ' ' ORDER BY tid) AS tokens, "
            f"string_agg(CAST({tag} AS VARCHAR), ' ' ORDER BY tid) AS ner_tags FROM alin WHERE {keep} GROUP BY sid")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # Predictions and scores.
    kept = f"""kept AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY tid) - 1 AS tid, tag_id, logits,
    {_softmax('logits')} AS p FROM raw WHERE NOT masked)"""
    q["softmax_mask"] = _with(WORDS, RAW, kept) + "SELECT sid, tid, " + ", ".join(
        f"round(p[{i + 1}], 6) AS p{i}" for i in range(7)) + " FROM kept"
    q["argmax_decode"] = _with(WORDS, RAW, kept) + (
        f"SELECT sid, tid, {_names(TEXT_TAGS)}[list_position(logits, list_max(logits))] AS pred, "
        f"{_names(TEXT_TAGS)}[tag_id + 1] AS gold FROM kept")
    q["unroll_scores"] = _with(WORDS, RAW) + "SELECT sid, tid, round(list_sum(logits), 6) AS total FROM raw"
    for name in ("entropy", "margin", "confidence", "lowest"):
        q[f"score_{name}"] = _with(*MEASURED) + f"SELECT sid, tid, round({name}, 6) AS score FROM measures"
    q["inverse_margin"] = _with(*MEASURED) + (
        "SELECT sid, tid, round(-ln(greatest(round(margin, 12), 1e-12)), 6) AS log_weight FROM measures")
    q["sentence_scores"] = _with(*MEASURED) + """SELECT sid, round(max(entropy), 6) AS max_entropy, round(min(margin), 6) AS min_margin,
  round(min(confidence), 6) AS min_confidence, round(avg(entropy), 6) AS mean_entropy, round(sum(margin), 6) AS sum_margin
  FROM measures GROUP BY sid"""
    q["exclude_tokens"] = _with(TOK, LAB) + "SELECT sid, tid, tag FROM tok WHERE (sid, tid) NOT IN (SELECT sid, tid FROM lab)"
    q["exclude_sentences"] = _with(TOK, SLAB) + (
        "SELECT sid, count(*) AS n FROM tok WHERE sid NOT IN (SELECT sid FROM slab) GROUP BY sid")
    q["collapse_tokens"] = _with(TOK, LAB) + (
        "SELECT sid, 0::BIGINT AS block_no, string_agg(CAST(tid AS VARCHAR), ' ' ORDER BY tid) AS tids FROM lab GROUP BY sid")
    q["length_check"] = _with(WORDS) + (
        "SELECT sid, (count(*) - 1)::INTEGER AS n_predictions, count(*)::INTEGER AS n_tags FROM words WHERE sid % 3 = 0 GROUP BY sid")

    # Query strategies.
    for s in ("random", "entropy", "breaking_ties", "least_confidence", "stochastic_breaking_ties"):
        q[f"tl_{s}"] = _with(*MEASURED, LAB) + f"SELECT sid, tid, round(score, 6) AS score FROM ({_token_pick(s)})"
        q[f"sl_{s}"] = _with(*MEASURED, SENTS, SLAB) + f"SELECT sid, round(score, 6) AS score FROM ({_sentence_pick(s)})"
        q[f"el_{s}"] = _with(
            *MEASURED, LAB, f"picks AS ({_token_pick(s)})", ANY_RUNS, EXPANDED) + "SELECT sid, tid FROM expanded"
    for name, value, down in (
        ("random", _u(1, "id"), False), ("entropy", "entropy", True), ("breaking_ties", "margin", False),
        ("least_confidence", "lowest", False), ("least_confidence_top", "confidence", False),
    ):
        inner = _ranked(value, "cm", "id", "", 100, down) if name != "random" else \
            f"SELECT id, {value} AS score FROM cm ORDER BY {value}, id LIMIT 100"
        q[f"sc_{name}"] = _with(CLASS) + f"SELECT id, round(score, 6) AS score FROM ({inner})"

    # Entities and annotation.
    picks = "picks AS (SELECT sid, tid FROM seeds)"
    q["run_entity"] = _with(TOK, SEEDS, picks, ANY_RUNS, EXPANDED) + "SELECT sid, tid FROM expanded"
    q["typed_entity"] = _with(TOK, SEEDS, BIO_RUNS) + """SELECT p.sid, p.tid AS seed, t.tid, coalesce(r.tag[1] = 'I', FALSE) AS invalid
  FROM seeds p LEFT JOIN biorun r ON r.sid = p.sid AND p.tid >= r.s AND p.tid < r.e
  JOIN tok t ON t.sid = p.sid AND t.tid >= coalesce(r.s, p.tid) AND t.tid < coalesce(r.e, p.tid + 1)"""
    q["annotate_sentences"] = _with(TOK, LAB, SEEDS) + """SELECT sid, tid, tag FROM tok
  WHERE sid IN (SELECT sid FROM seeds) OR (sid, tid) IN (SELECT sid, tid FROM lab)"""
    q["annotate_tokens"] = _with(TOK, LAB, SEEDS) + """SELECT sid, tid, tag FROM tok
  WHERE (sid, tid) IN (SELECT sid, tid FROM seeds UNION SELECT sid, tid FROM lab)"""
    q["annotated_guard"] = _with(TOK, LAB, SEEDS) + "SELECT sid, tid, tag FROM lab JOIN seeds USING (sid, tid)"
    q["annotated_count"] = _with(TOK, LAB) + "SELECT sid, count(*) AS n_annotated FROM lab GROUP BY sid"
    q["annotated_values"] = _with(WORDS, AL) + "SELECT sid, tid, al_tag::INTEGER AS tag_id FROM al WHERE al_tag <> -100"
    al3 = f"al3 AS (SELECT sid, tid, CASE WHEN {_u(13, 'sid', 'tid')} < 0.3 THEN tag_id ELSE -100 END AS t FROM words)"
    q["annotated_arrays"] = _with(WORDS, al3) + (
        "SELECT sid, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY tid) AS al_tags FROM al3 GROUP BY sid HAVING max(t) > -100")

    # Training rows.
    q["candidates"] = _with(WORDS, AL, CANDS) + 'SELECT sid, s AS start, e AS "end", fully AS full_span FROM cands'
    q["train_mask_all"] = _with(WORDS, AL, CANDS) + _train("al_tag")
    q["train_drop_all"] = _with(WORDS, AL, CANDS) + _train("al_tag", "al_tag <> -100")
    q["train_mask_entity"] = _with(WORDS, AL, CANDS) + _train("CASE WHEN al_tag = -100 AND NOT inside THEN 0 ELSE al_tag END")
    q["train_drop_entity"] = _with(WORDS, AL, CANDS) + f"""SELECT sid, 0 AS window_no, coalesce(tokens, '') AS tokens, coalesce(ner_tags, '') AS ner_tags
  FROM full_rows LEFT JOIN ({_train("CASE WHEN al_tag = -100 THEN 0 ELSE al_tag END", "al_tag <> -100 OR NOT inside")}) USING (sid)"""
    q["train_dynamic_window"] = _with(WORDS, AL, CANDS, WINDOWS) + """SELECT sid, no::INTEGER AS window_no,
  string_agg(word, ' ' ORDER BY tid) AS tokens, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY tid) AS ner_tags FROM win_words GROUP BY sid, no"""
    q["train_rejects"] = _with(WORDS, AL) + """SELECT sid, string_agg(word, ' ' ORDER BY tid) AS tokens FROM al
  GROUP BY sid HAVING max(al_tag) = -100"""
    q["training_stats"] = _with(WORDS, AL, CANDS, WINDOWS) + """SELECT (SELECT count(*) FROM wins) AS n_rows,
  (SELECT count(*) FROM win_words WHERE t <> -100) AS n_unmasked"""

    # Metrics.
    q["io_spans"] = _with(*IO) + 'SELECT sid, s AS start, e AS "end", tag AS type FROM goldrun'
    q["io_counts"] = _with(*IO) + IO_COUNTS
    q["io_prf"] = _with(*IO, f"c AS ({IO_COUNTS})", """r AS (SELECT *, n_correct / (n_pred + 1e-8::DOUBLE) AS p,
  n_correct / (n_gold + 1e-8::DOUBLE) AS rc FROM c)""") + """SELECT n_pred, n_gold, n_correct, round(p, 6) AS precision,
  round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM r"""
    q["type_errors"] = _with(*IO) + """SELECT
  count(*) FILTER (WHERE g.tag <> p.tag AND split_part(g.tag, '-', 1) = split_part(p.tag, '-', 1)) AS within,
  count(*) FILTER (WHERE split_part(g.tag, '-', 1) <> split_part(p.tag, '-', 1)) AS outer,
  round(count(*) + 1e-6::DOUBLE, 6) AS same_span FROM goldrun g JOIN predrun p USING (sid, s, e)"""
    q["bio_entities"] = _with(TOK, BIO_RUNS) + """SELECT sid, s AS start, e AS "end", tag[3:] AS type, tag[1] = 'I' AS invalid FROM biorun"""
    ptok = f"ptok AS (SELECT sid, tid, {_names(LINE_TAGS)}[list_position(scores, list_max(scores))] AS tag FROM pred)"
    q["bio_prf"] = _with(
        TOK, PRED, ptok, BIO_RUNS, _runs("prun", "ptok", BIO_BREAK),
        """sp AS (SELECT coalesce(g.tag[3:], p.tag[3:]) AS type, g.sid IS NOT NULL AS g, p.sid IS NOT NULL AS p
  FROM biorun g FULL JOIN prun p ON g.sid = p.sid AND g.s = p.s AND g.e = p.e AND g.tag[3:] = p.tag[3:])""",
        """cc AS (SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS type, count(*) FILTER (WHERE g) AS ng,
  count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE g AND p) AS nc FROM sp GROUP BY GROUPING SETS ((type), ()))""",
        """rr AS (SELECT *, CASE WHEN np > 0 THEN nc / np::DOUBLE ELSE 0 END AS pr, CASE WHEN ng > 0 THEN nc / ng::DOUBLE ELSE 0 END AS re FROM cc)""",
    ) + """SELECT type, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, ng AS number,
  CASE WHEN type = 'overall' THEN (SELECT round(avg(CASE WHEN tok.tag = ptok.tag THEN 1.0 ELSE 0.0 END), 6) FROM tok JOIN ptok USING (sid, tid)) END AS accuracy
  FROM rr"""
    q["bio_prf_splits"] = _with(
        TOK, PRED, ptok, BIO_RUNS, _runs("prun", "ptok", BIO_BREAK),
        """sp AS (SELECT 'part' || (coalesce(g.sid, p.sid) % 3) AS split, coalesce(g.tag[3:], p.tag[3:]) AS type, g.sid IS NOT NULL AS g, p.sid IS NOT NULL AS p
  FROM biorun g FULL JOIN prun p ON g.sid = p.sid AND g.s = p.s AND g.e = p.e AND g.tag[3:] = p.tag[3:])""",
        """cc AS (SELECT split, CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS type, count(*) FILTER (WHERE g) AS ng,
  count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE g AND p) AS nc FROM sp GROUP BY GROUPING SETS ((split, type), (split)))""",
        "acc AS (SELECT 'part' || (sid % 3) AS split, avg(CASE WHEN tok.tag = ptok.tag THEN 1.0 ELSE 0.0 END) AS a FROM tok JOIN ptok USING (sid, tid) GROUP BY 1)",
        """rr AS (SELECT *, CASE WHEN np > 0 THEN nc / np::DOUBLE ELSE 0 END AS pr, CASE WHEN ng > 0 THEN nc / ng::DOUBLE ELSE 0 END AS re FROM cc)""",
    ) + """SELECT split, type, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, ng AS number, CASE WHEN type = 'overall' THEN round(a, 6) END AS accuracy
  FROM rr JOIN acc USING (split)"""
    q["tag_distribution"] = _with(TOK, LAB) + "SELECT tag, count(*) AS n FROM lab GROUP BY tag"
    stats = """SELECT count(*) AS n_annotated, count(*) FILTER (WHERE tag <> 'O') AS n_non_o, count(DISTINCT sid) AS n_sentences,
  (SELECT count(*) FROM tok) AS n_tokens, round(count(*) / (SELECT count(*) FROM tok)::DOUBLE * 100, 6) AS percentage FROM {}"""
    q["annotation_stats"] = _with(TOK, LAB) + stats.format("lab")

    # Sources.
    split = SPLIT.format("sid")
    flat = f"""flat AS (SELECT sid, {split} AS split, string_agg(word, ' ' ORDER BY tid) AS tokens,
    string_agg([chr(34), chr(39) || chr(39), '#'][CASE pos WHEN 'NNP' THEN 2 WHEN 'IN' THEN 3 ELSE 1 END], ' ' ORDER BY tid) AS pos_tags_text,
    string_agg(CAST(tag_id AS VARCHAR), ' ' ORDER BY tid) AS ner_tags FROM words GROUP BY sid)"""
    q["flat_corpus"] = _with(WORDS, flat) + """SELECT sid AS id, split, tokens, pos_tags_text, ner_tags FROM flat
  UNION ALL SELECT sid, 'val_train', tokens, pos_tags_text, ner_tags FROM flat WHERE split = 'validation'"""
    lines = f"""lines_of AS (SELECT sid, count(*) AS n, count(*) - (sid % 11 = 0)::INT AS n_tags,
  string_agg(CAST(tag_id AS VARCHAR), ' ' ORDER BY tid) AS tags, CASE WHEN sid % 23 = 0 THEN 'dev' ELSE {split} END AS split FROM words GROUP BY sid),
judged AS (SELECT *, CASE WHEN sid % 19 = 0 THEN ['corrupt'] ELSE list_filter([
  CASE WHEN sid % 23 = 0 THEN 'split' END, CASE WHEN sid % 17 = 0 THEN 'tokens' END,
  CASE WHEN sid % 11 = 0 AND sid % 17 <> 0 THEN 'ner_tags length' END, CASE WHEN sid % 13 = 0 AND n_tags > 0 THEN 'ner_tags range' END],
  lambda r: r IS NOT NULL) END AS reasons FROM lines_of)"""
    q["flat_accepted"] = _with(WORDS, lines) + "SELECT sid::VARCHAR AS id, split, n::INTEGER AS n_tokens, tags AS ner_tags FROM judged WHERE len(reasons) = 0"
    q["flat_rejects"] = _with(WORDS, lines) + """SELECT CASE WHEN sid % 19 <> 0 THEN sid::VARCHAR END AS id, CASE WHEN sid % 19 <> 0 THEN split END AS split,
  array_to_string(reasons, ', ') AS reasons FROM judged WHERE len(reasons) > 0"""
    q["flatten_documents"] = _with(WORDS) + """SELECT doc_id AS document_id, line_no AS position, string_agg(word, ' ' ORDER BY tid) AS tokens,
  string_agg(CASE pos WHEN 'NNP' THEN '1' WHEN 'IN' THEN '2' ELSE '0' END, ' ' ORDER BY tid) AS pos_tags,
  string_agg(CAST(length(word) % 5 AS VARCHAR), ' ' ORDER BY tid) AS ner_tags FROM words GROUP BY doc_id, line_no
  UNION ALL SELECT doc_id, line_no, '', '', '' FROM split_lines WHERE len(ws) = 0"""
    held_docs = f"""held AS (SELECT doc_id AS id FROM documents ORDER BY {_u(1, 'doc_id')}, doc_id
  LIMIT (SELECT ceil(count(*) * 0.01::DOUBLE)::BIGINT FROM documents))"""
    q["nested_corpus"] = _with(WORDS, held_docs) + """SELECT doc_id AS document_id,
  CASE WHEN doc_id IN (SELECT id FROM held) THEN 'val_train' ELSE 'train' END AS split,
  count(*) AS n_sentences, CAST(sum(len(ws)) AS BIGINT) AS n_tokens FROM split_lines GROUP BY doc_id"""
    io_names = "['O', 'PAGE-CLICK', 'PAGE-ERROR', 'SHOP-BUY', 'SHOP-JOIN', 'ART-FILM', 'ART-SONG']"
    held_sids = f"""sids AS (SELECT DISTINCT sid FROM words WHERE {split} = 'train'),
held AS (SELECT sid FROM sids ORDER BY {_u(1, 'sid')}, sid LIMIT (SELECT ceil(count(*) * 0.01::DOUBLE)::BIGINT FROM sids))"""
    for kind, value in (("coarse", "tag_id"), ("fine", "length(word) % 5")):
        q[f"io_corpus_{kind}"] = _with(WORDS, held_sids) + f"""SELECT sid AS id,
  CASE WHEN sid IN (SELECT sid FROM held) THEN 'val_train' ELSE {split} END AS split,
  string_agg(word, ' ' ORDER BY tid) AS tokens, string_agg({io_names}[{value} + 1], ' ' ORDER BY tid) AS tags FROM words GROUP BY sid"""
    q["holdout_split"] = f"""SELECT o_orderkey AS id, CASE WHEN row_number() OVER (ORDER BY {_u(1, 'o_orderkey')}, o_orderkey)
    <= (SELECT ceil(count(*) * 0.01::DOUBLE) FROM orders) THEN 'val_train' ELSE 'train' END AS split FROM orders"""
    osplit = SPLIT.format("o_orderkey")
    q["full_split"] = f"""SELECT o_orderkey AS id, {osplit} AS split FROM orders
  UNION ALL SELECT o_orderkey, 'val_train' FROM orders WHERE {osplit} = 'validation'"""
    q["dense_ids"] = f"""SELECT o_orderkey AS id, {osplit} AS split,
  row_number() OVER (PARTITION BY {osplit} ORDER BY o_orderkey) - 1 AS sid FROM orders"""
    q["dense_ids_text"] = f"""SELECT 'o' || o_orderkey AS id, {osplit} AS split,
  row_number() OVER (PARTITION BY {osplit} ORDER BY 'o' || o_orderkey) - 1 AS sid FROM orders"""
    q["token_table"] = _with(WORDS) + (
        f"SELECT sid, tid, word AS token, pos, tag_id::INTEGER AS tag_id, {_names(TEXT_TAGS)}[tag_id + 1] AS tag FROM words")
    view = "SELECT s.sid, {0} AS text, {1} AS ner_tags, {2} AS pos_tags FROM (SELECT DISTINCT sid FROM words) s LEFT JOIN (SELECT * FROM words{3}) w ON w.sid = s.sid GROUP BY s.sid"
    agg = lambda e: f"coalesce(string_agg({e}, ' ' ORDER BY tid), '')"
    for name, where in (("text_view", ""), ("text_view_nouns", " WHERE pos LIKE '%NNP%'")):
        q[name] = _with(WORDS) + view.format(agg("word"), agg(f"{_names(TEXT_TAGS)}[tag_id + 1]"), agg("pos"), where)
    io_view = f"""iov AS (SELECT sid, string_agg(word, ' ' ORDER BY tid) AS text,
    string_agg({io_names}[tag_id + 1], ' ' ORDER BY tid) AS ner_tags FROM words WHERE NOT sid IN (SELECT sid FROM held) GROUP BY sid)"""
    q["text_view_io"] = _with(WORDS, held_sids, io_view) + "SELECT sid, text, ner_tags, '' AS pos_tags FROM iov"
    q["init_longest_io"] = _with(WORDS, held_sids, io_view) + """SELECT sid, round(len(string_split(text, ' ')), 6) AS score FROM iov
  ORDER BY len(string_split(text, ' ')) DESC, sid LIMIT 100"""
    q["align_labels"] = _with(WORDS) + """SELECT sid, '-100 ' || string_agg(tag_id || CASE WHEN length(word) > 6 THEN ' -100' ELSE '' END, ' ' ORDER BY tid)
  || ' -100' AS labels FROM words GROUP BY sid"""

    # Vectors and initial sets.
    q["tfidf"] = _with(*_weights(2, False)) + "SELECT sid, term, round(w, 6) AS w FROM weights"
    q["tfidf_unit"] = _with(*_weights(1, True, True)) + "SELECT sid, term, round(w, 6) AS w FROM weights"
    q["tfidf_transform"] = _with(
        _terms(1, True), "tf AS (SELECT sid, term, count(*) AS tf FROM terms GROUP BY sid, term)",
        "df AS (SELECT term, count(*) AS df FROM tf WHERE sid % 2 = 0 GROUP BY term)",
        """plain AS (SELECT sid, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents WHERE doc_id % 2 = 0)) / (df + 1)) + 1) AS w
  FROM tf JOIN df USING (term) WHERE sid % 2 = 1)""",
    ) + "SELECT sid, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY sid)), 6) AS w FROM plain"
    q["tfidf_updated"] = _with(_terms(1, True)) + """SELECT term, count(DISTINCT sid) AS df, (SELECT count(*) FROM documents) AS n
  FROM terms GROUP BY term"""
    q["cosine_distance"] = _with(*_weights(1, True, True)) + """SELECT a.sid AS pair, round(1 - coalesce(sum(a.w * b.w), 0), 6) AS distance
  FROM weights a LEFT JOIN weights b ON b.sid = a.sid + 1 AND b.term = a.term GROUP BY a.sid"""
    q["init_random"] = f"SELECT doc_id AS sid, round({_u(1, 'doc_id')}, 6) AS score FROM documents ORDER BY {_u(1, 'doc_id')}, doc_id LIMIT 100"
    q["init_longest"] = """SELECT doc_id AS sid, round(len(string_split(text, ' ')), 6) AS score FROM documents
  ORDER BY len(string_split(text, ' ')) DESC, doc_id LIMIT 100"""
    q["init_tfidf"] = _with(*_weights(2, False), TOPMEAN) + (
        "SELECT sid, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, sid LIMIT 100")
    key = f"round(ln(-ln({_u(1, 'sid')})) - score / 5, 9)"
    q["init_tfidf_prob"] = _with(*_weights(2, True), TOPMEAN) + (
        f"SELECT sid, round({key}, 6) AS score FROM scored ORDER BY {key}, sid LIMIT 100")
    q["init_dissimilar"] = _with(*_weights(1, True, True), """dots AS (SELECT a.sid, b.sid AS other, sum(a.w * b.w) AS dot
  FROM weights a JOIN weights b ON a.term = b.term AND a.sid <> b.sid GROUP BY a.sid, b.sid)""",
        "near AS (SELECT sid, max(dot) AS dot FROM dots GROUP BY sid)",
        "dis AS (SELECT doc_id AS sid, round(1 - coalesce(dot, 0), 9) AS score FROM documents LEFT JOIN near ON near.sid = doc_id)",
    ) + "SELECT sid, round(score, 6) AS score FROM dis ORDER BY dis.score DESC, sid LIMIT 100"
    counts = "counts AS (SELECT sid, count(*) FILTER (WHERE tag LIKE '%PER') AS per, count(*) FILTER (WHERE tag LIKE '%ORG') AS org FROM tok GROUP BY sid)"
    q["init_supervised"] = _with(
        TOK, counts,
        f"a AS (SELECT sid FROM counts ORDER BY org DESC, sid LIMIT {K // 2})",
        f"b AS (SELECT sid FROM counts WHERE sid NOT IN (SELECT sid FROM a) ORDER BY per DESC, sid LIMIT {K // 2})",
    ) + "SELECT sid, 'ORG' AS reason FROM a UNION ALL SELECT sid, 'PER' FROM b"
    q["init_static"] = "SELECT doc_id AS sid FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)"
    q["init_nnp_freq"] = _with(
        WORDS, "shares AS (SELECT word, count(*) FILTER (WHERE pos = 'NNP') / count(*)::DOUBLE AS share FROM words GROUP BY word)",
        "sc AS (SELECT sid, round(coalesce(avg(share) FILTER (WHERE pos LIKE '%NNP%'), 0), 9) AS score FROM words JOIN shares USING (word) GROUP BY sid)",
    ) + "SELECT sid, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, sid LIMIT 100"
    q["init_nnp_filter"] = _with(
        WORDS, "ok AS (SELECT sid FROM words GROUP BY sid HAVING count(*) FILTER (WHERE pos LIKE '%NNP%') > 0.5 * ln(count(*)))",
    ) + f"SELECT sid, round({_u(1, 'sid')}, 6) AS score FROM ok ORDER BY {_u(1, 'sid')}, sid LIMIT 100"
    q["init_lm_ties"] = _with("""lm AS (SELECT vec_id // 8 AS sid, list_reverse_sort(list_transform(embedding, lambda v: v::DOUBLE)) AS s FROM embeddings),
ms AS (SELECT sid, round(min(s[1] - s[2]), 9) AS score FROM lm GROUP BY sid)""") + (
        "SELECT sid, round(score, 6) AS score FROM ms ORDER BY ms.score, sid LIMIT 50")
    fade = """SELECT sid, CASE WHEN max(s) < 1e-6 THEN 0 ELSE avg(w) END AS score FROM (
    SELECT sid, w, row_number() OVER (PARTITION BY sid ORDER BY w DESC) AS r, sum(w) OVER (PARTITION BY sid) AS s FROM (
      SELECT sid, w * pow(2.0::DOUBLE, -coalesce(c, 0)) AS w FROM gw LEFT JOIN {cnt} USING (term))) WHERE r <= 5 GROUP BY sid"""
    q["init_tfidf_nodup"] = _with(
        *_weights(1, True), "gw AS MATERIALIZED (SELECT * FROM weights)",
        _greedy("SELECT doc_id AS sid FROM documents", fade, "d.sid")) + _all_picks()
    uncovered = "SELECT sid, sum(w)::DOUBLE AS score FROM gw WHERE term NOT IN (SELECT term FROM {cnt}) GROUP BY sid"
    q["init_cover"] = _with(
        WORDS, "gw AS MATERIALIZED (SELECT sid, word AS term, count(*) AS w FROM words WHERE tag_id > 0 GROUP BY sid, word)",
        "ids AS MATERIALIZED (SELECT DISTINCT sid FROM words)",
        _greedy("SELECT sid FROM ids", uncovered, _u(1, "d.sid"))) + _all_picks()

    # One row for each pick: the terms seen and the ids picked so far travel with it.
    q["init_cover_share"] = _with(
        WORDS, "gw AS MATERIALIZED (SELECT sid, word AS term, count(*) AS w FROM words WHERE tag_id > 0 GROUP BY sid, word)",
        "ids AS MATERIALIZED (SELECT DISTINCT sid FROM words)",
        f"""packed AS MATERIALIZED (SELECT i.sid, {_u(1, 'i.sid')} AS tie, coalesce(list(term) FILTER (WHERE term IS NOT NULL), []) AS ts,
  coalesce(list(w::DOUBLE) FILTER (WHERE term IS NOT NULL), []) AS ws FROM ids i LEFT JOIN gw USING (sid) GROUP BY i.sid)""",
        """greedy(step, sid, score, seen, done) AS (
  SELECT 0::BIGINT, CAST(NULL AS BIGINT), 0.0::DOUBLE, []::VARCHAR[], []::BIGINT[]
  UNION ALL
  SELECT step + 1, arg_min(sid, k), -min(k).a, list_concat(any_value(seen), arg_min(ts, k)), list_append(any_value(done), arg_min(sid, k))
  FROM (SELECT step, seen, done, sid, ts, struct_pack(a := -s, b := tie, c := sid) AS k FROM (SELECT step, seen, done, p.sid, tie, ts,
    round(coalesce(list_sum(list_transform(ws, lambda x, i: CASE WHEN list_contains(seen, ts[i]) THEN 0.0::DOUBLE ELSE x END)), 0), 9) AS s
    FROM greedy, packed p WHERE NOT list_contains(done, p.sid)))
  WHERE step < (SELECT count(*) // 100 FROM ids) GROUP BY step)""",
    ) + "SELECT step::INTEGER AS step, sid, round(score, 6) AS score FROM greedy WHERE step > 0"

    for name, down in (("init_kmeans", True), ("init_kmeans_nearest", False)):
        q[name] = _kmeans(down)

    # One round.
    one = [*MEASURED, LAB, f"picks AS ({_token_pick('breaking_ties')})", ANY_RUNS, EXPANDED, REVEALED]
    q["al_round"] = _with(*one) + "SELECT tag, count(*) AS n FROM revealed GROUP BY tag"
    steps = [
        WORDS,
        "pool AS MATERIALIZED (SELECT sid, tid, word, tag_id FROM words WHERE sid % 10 < 8)",
        f"""begun AS MATERIALIZED (SELECT sid FROM (SELECT DISTINCT sid FROM pool) ORDER BY {_u(1, 'sid')}, sid
  LIMIT (SELECT floor(count(DISTINCT sid) * 0.05::DOUBLE)::BIGINT FROM pool))""",
        "lab0 AS MATERIALIZED (SELECT * FROM pool WHERE sid IN (SELECT sid FROM begun))",
        "known0 AS MATERIALIZED (SELECT sid, tid, word, tag_id, 0 AS round FROM lab0)",
    ]
    for n in (1, 2):
        steps += [
            f"freq{n} AS (SELECT word, " + ", ".join(f"count(*) FILTER (WHERE tag_id = {i}) AS n{i}" for i in range(7)) + f", count(*) AS n FROM known{n - 1} GROUP BY word)",
            f"guess{n} AS (SELECT p.sid, p.tid, p.word, p.tag_id, list_reverse_sort([" + ", ".join(
                f"(coalesce(n{i}, 0) + 1) / (coalesce(n, 0) + 7.0::DOUBLE)" for i in range(7))
            + f"]) AS s FROM pool p LEFT JOIN freq{n} USING (word) ANTI JOIN known{n - 1} k ON p.sid = k.sid AND p.tid = k.tid)",
            f"more{n} AS MATERIALIZED (SELECT * FROM guess{n} ORDER BY round(s[1] - s[2], 9), sid, tid LIMIT {K})",
            f"known{n} AS MATERIALIZED (SELECT * FROM known{n - 1} UNION ALL SELECT sid, tid, word, tag_id, {n} FROM more{n})",
        ]
    steps.append("known AS (SELECT * FROM known1)")
    q["al_loop"] = _with(*steps) + f"SELECT sid, tid, {_names(TEXT_TAGS)}[tag_id + 1] AS tag FROM known"
    q["results_log"] = _with(*steps) + """SELECT r.round::INTEGER AS round, 'token' AS level, 'breaking_ties' AS strategy, count(*) AS n_annotated,
  count(*) FILTER (WHERE tag_id > 0) AS n_non_o, count(DISTINCT sid) AS n_sentences,
  round(count(*) * 100 / (SELECT count(*) FROM pool)::DOUBLE, 6) AS percentage
  FROM known JOIN (VALUES (0), (1)) AS r(round) ON known.round <= r.round GROUP BY r.round"""
    q["al_loop_resumed"] = _with(*steps) + f"SELECT sid, tid, {_names(TEXT_TAGS)}[tag_id + 1] AS tag, round::INTEGER AS round FROM known2"
    q["al_round_stats"] = _with(*one) + stats.format("revealed")
    return q
