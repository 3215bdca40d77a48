"""DuckDB building blocks for the oracles: derived streams, tokens, models, detectors."""

from __future__ import annotations

TOKEN = "[a-z0-9]+(?:''[a-z]+)?"


def with_(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(c.strip() for c in ctes if c) + "\n"


def unescape(x: str) -> str:
    """The character references that occur in the pages; the ampersand last."""
    return (f"replace(regexp_replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&amp([^;]|$)', '&\\1', 'g'), '&amp;', '&')")


def squeeze(x: str) -> str:
    """Shorten runs of a token character to two (RE2 has no back-references)."""
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


# The same for any character: drop one that equals both before it.
SQUEEZED_DOCUMENTS = """
SELECT doc_id, md5(coalesce(string_agg(c, '' ORDER BY i), '')) AS digest FROM (
  SELECT doc_id, i, c, lag(c, 1) OVER p AS c1, lag(c, 2) OVER p AS c2 FROM (
    SELECT doc_id, unnest(chars) AS c, unnest(range(len(chars))) AS i FROM (
      SELECT doc_id, string_split(text, '') AS chars FROM documents))
  WINDOW p AS (PARTITION BY doc_id ORDER BY i))
WHERE c = chr(10) OR c IS DISTINCT FROM c1 OR c IS DISTINCT FROM c2 GROUP BY doc_id"""


def cleaned(source: str, key: str, text: str, extra: str = "") -> str:
    """CTE `cleaned(key, text, ...)`: lowercase, no URLs or mentions, hashtags open, squeezed."""
    more = f", {extra}" if extra else ""
    plain = (f"replace(regexp_replace(regexp_replace(lower({text}), "
             "'(?:https?://|www\\.)[^\\s\\x{a0}]+', ' ', 'g'), '@[\\p{L}\\p{N}_]+', ' ', 'g'), '#', ' ')")
    return f"""
cleaned AS (SELECT {key}{more}, {squeeze(plain)} AS text FROM {source})"""


DOCS = f"""
doc_rows AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id AS id, text, lang, source, toxic, quality
  FROM documents JOIN labels USING (doc_id)),
{cleaned('doc_rows', 'idx', 'text', 'id, lang, source, toxic, quality').strip()},
doc_tokens AS (
  SELECT idx, id, lang, source, toxic, quality, regexp_extract_all(text, '{TOKEN}') AS tokens FROM cleaned)"""

# rows(idx, t, label) and words(idx, word, k) of the documents stream.
DOCS_ROWS = DOCS + """,
rows AS (
  SELECT idx, epoch_us(TIMESTAMP '2024-01-01' + to_hours(CAST(idx AS INTEGER))) / CAST(3.6e9 AS DOUBLE) AS t,
         toxic AS label FROM doc_tokens),
words AS (
  SELECT idx, word, count(*) AS k FROM (SELECT idx, unnest(tokens) AS word FROM doc_tokens) GROUP BY ALL)"""

EVENTS = """
ev AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, event_id AS id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k FROM events),
ev_tokens AS (
  SELECT idx, id, ts, user_id, event_type, value, k, CASE WHEN value > 34.6 THEN 1 ELSE 0 END AS label,
         [event_type, 'u' || CAST(user_id % 20 AS VARCHAR), 'k' || CAST(k AS VARCHAR),
          'v' || CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR)] AS tokens FROM ev)"""


def events_rows(flip: bool = False) -> str:
    """CTEs rows(idx, t, label) and words(idx, word, k) of the events stream."""
    label = "CASE WHEN idx >= (SELECT count(*) // 2 FROM ev) THEN 1 - label ELSE label END" if flip else "label"
    return EVENTS + f""",
rows AS (SELECT idx, epoch_us(ts) / CAST(3.6e9 AS DOUBLE) AS t, {label} AS label FROM ev_tokens),
words AS (SELECT idx, word, count(*) AS k FROM (SELECT idx, unnest(tokens) AS word FROM ev_tokens) GROUP BY ALL)"""


# Needs rows, words and segs(model, b, lam, alpha, lo, hi); gives scored(model, lo, idx, ...).
# The normaliser is one telescoping sum over all rows since b, with a single reference time.
SCORED = """
seg_rows AS (
  SELECT s.*, r.idx, r.t, r.label, min(r.t) OVER (PARTITION BY s.model, s.lo) AS t0
  FROM segs s JOIN rows r ON r.idx BETWEEN s.b AND s.hi),
word_state AS (
  SELECT sr.*, w.word, w.k,
    coalesce(sum(CASE WHEN label = 0 THEN k END) OVER p, 0) AS m0,
    coalesce(sum(CASE WHEN label = 1 THEN k END) OVER p, 0) AS m1,
    max(CASE WHEN label = 0 THEN t END) OVER p AS u0, max(CASE WHEN label = 1 THEN t END) OVER p AS u1
  FROM seg_rows sr JOIN words w USING (idx)
  WINDOW p AS (PARTITION BY model, lo, word ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
terms AS (
  SELECT model, lo, idx,
    sum(CASE WHEN m0 + m1 > 0 THEN k * ln(coalesce(m0 * exp(-lam * (t - u0)), 0) + alpha) ELSE 0 END) AS term0,
    sum(CASE WHEN m0 + m1 > 0 THEN k * ln(coalesce(m1 * exp(-lam * (t - u1)), 0) + alpha) ELSE 0 END) AS term1,
    sum(CASE WHEN m0 + m1 > 0 THEN k ELSE 0 END) AS known,
    sum(CASE WHEN m0 + m1 = 0 THEN 1 ELSE 0 END) AS new_words,
    sum(CASE WHEN (CASE label WHEN 0 THEN m0 ELSE m1 END) = 0 THEN 1 ELSE 0 END) AS new_entries,
    sum(CASE WHEN label = 0 THEN (m0 + k) * exp(lam * (t - t0)) - coalesce(m0 * exp(lam * (u0 - t0)), 0) ELSE 0 END) AS d0,
    sum(CASE WHEN label = 1 THEN (m1 + k) * exp(lam * (t - t0)) - coalesce(m1 * exp(lam * (u1 - t0)), 0) ELSE 0 END) AS d1
  FROM word_state GROUP BY ALL),
doc_state AS (
  SELECT r.model, r.lo, r.lam, r.alpha, r.idx, r.t, r.label,
    coalesce(term0, 0) AS term0, coalesce(term1, 0) AS term1, coalesce(known, 0) AS known,
    coalesce(new_entries, 0) AS new_entries,
    coalesce(sum(new_words) OVER p, 0) AS vocab, coalesce(sum(new_entries) OVER p, 0) AS entries,
    count(*) FILTER (label = 0) OVER p AS n0, count(*) FILTER (label = 1) OVER p AS n1,
    max(CASE WHEN label = 0 THEN t END) OVER p AS last0, max(CASE WHEN label = 1 THEN t END) OVER p AS last1,
    greatest(coalesce(sum(d0) OVER p, 0), 0) * exp(-lam * (t - t0)) AS norm0,
    greatest(coalesce(sum(d1) OVER p, 0), 0) * exp(-lam * (t - t0)) AS norm1
  FROM seg_rows r LEFT JOIN terms m ON m.model = r.model AND m.lo = r.lo AND m.idx = r.idx
  WINDOW p AS (PARTITION BY r.model, r.lo ORDER BY r.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
class_scores AS (
  SELECT *, CASE WHEN n0 > 0 AND n1 > 0 THEN ln(n0) - lam * (t - last0)
      + CASE WHEN known > 0 THEN term0 - known * ln(norm0 + alpha * vocab) ELSE 0 END END AS s0,
    CASE WHEN n0 > 0 AND n1 > 0 THEN ln(n1) - lam * (t - last1)
      + CASE WHEN known > 0 THEN term1 - known * ln(norm1 + alpha * vocab) ELSE 0 END END AS s1
  FROM doc_state WHERE idx >= lo),
scored AS (
  SELECT *, CAST(CASE WHEN n0 > 0 AND n1 > 0 THEN s1 - s0 > 1e-9 + 1e-12 * (abs(s0) + abs(s1))
                 ELSE n1 > n0 END AS INTEGER) AS pred FROM class_scores)"""


def whole_segments(*models: tuple) -> str:
    """segs of models (name, lam, alpha) that never change."""
    values = ", ".join(f"('{m}', CAST({lam} AS DOUBLE), CAST({alpha} AS DOUBLE))" for m, lam, alpha in models)
    return f"""
segs AS (
  SELECT model, 0 AS b, lam, alpha, 0 AS lo, (SELECT max(idx) FROM rows) AS hi
  FROM (VALUES {values}) AS v(model, lam, alpha))"""


def seen_words(w: int) -> str:
    return f"""
seen AS (
  SELECT DISTINCT r.idx // {w} AS win, r.label AS class, w.word FROM rows r JOIN words w USING (idx)
  WHERE r.idx // {w} < (SELECT count(*) // {w} FROM rows))"""


def precisions(w: int, reference: str = "previous") -> str:
    """CTE prec(win, p0, p1)."""
    if reference == "previous":
        base = f"""
sizes AS (SELECT win, class, count(*) AS size FROM seen GROUP BY ALL),
shared AS (
  SELECT a.win, a.class, count(*) AS hit FROM seen a
  JOIN seen b ON b.class = a.class AND b.word = a.word AND b.win = a.win - 1 GROUP BY ALL),
ratios AS (
  SELECT g.win, g.class, coalesce(s.hit, 0) / CAST(z.size AS DOUBLE) AS p FROM checks_grid g
  JOIN sizes z ON z.class = g.class AND z.win = g.win - 1
  LEFT JOIN shared s ON s.win = g.win AND s.class = g.class)"""
    else:
        base = """
ratios AS (
  SELECT g.win, g.class, (SELECT count(DISTINCT a.word) FROM seen a JOIN seen b ON b.class = a.class
      AND b.word = a.word AND b.win < a.win WHERE a.win = g.win AND a.class = g.class)
    / CAST((SELECT count(DISTINCT word) FROM seen WHERE class = g.class AND win < g.win) AS DOUBLE) AS p
  FROM checks_grid g
  WHERE EXISTS (SELECT 1 FROM seen WHERE class = g.class AND win < g.win))"""
    return f"""
checks_grid AS (
  SELECT win, class FROM range(0, (SELECT count(*) // {w} FROM rows)) AS x(win), (VALUES (0), (1)) AS c(class)),
{base.strip()},
prec AS (
  SELECT g.win, max(CASE WHEN g.class = 0 THEN p END) AS p0, max(CASE WHEN g.class = 1 THEN p END) AS p1
  FROM checks_grid g LEFT JOIN ratios r ON r.win = g.win AND r.class = g.class GROUP BY g.win)"""


def _severity(h: str, p: str, alpha: float, beta: float) -> str:
    mean, spread = f"list_avg({h})", f"list_aggregate({h}, 'stddev_pop')"
    return (f"CASE WHEN {p} IS NULL OR len({h}) < 3 OR abs({p} - {mean}) <= 1e-12 THEN 0 "
            f"WHEN abs({p} - {mean}) > {alpha} * {spread} THEN 2 "
            f"WHEN abs({p} - {mean}) > {beta} * {spread} THEN 1 ELSE 0 END")


def _remember(h: str, p: str, sig: str, history: int) -> str:
    return (f"CASE WHEN {p} IS NULL THEN {h} WHEN {sig} = 2 THEN [{p}] "
            f"WHEN len({h}) >= {history} THEN list_append({h}[2:], {p}) ELSE list_append({h}, {p}) END")


def signals(w: int, alpha: float = 1.8, beta: float = 0.334, history: int = 20) -> str:
    """CTE checks(win, idx, p0, p1, signal, train_from); a recursive fold over the windows."""
    return f"""
fold AS (
  SELECT CAST(-1 AS BIGINT) AS win, CAST([] AS DOUBLE[]) AS h0, CAST([] AS DOUBLE[]) AS h1, 0 AS g0, 0 AS g1
  UNION ALL
  SELECT win, {_remember('h0', 'p0', 'g0', history)}, {_remember('h1', 'p1', 'g1', history)}, g0, g1 FROM (
    SELECT c.win, f.h0, f.h1, c.p0, c.p1, {_severity('f.h0', 'c.p0', alpha, beta)} AS g0,
           {_severity('f.h1', 'c.p1', alpha, beta)} AS g1
    FROM fold f JOIN prec c ON c.win = f.win + 1)),
signalled AS (
  SELECT p.win, (p.win + 1) * {w} - 1 AS idx, p.p0, p.p1,
    CASE greatest(f.g0, f.g1) WHEN 2 THEN 'change' WHEN 1 THEN 'warning' ELSE 'none' END AS signal
  FROM prec p JOIN fold f USING (win)),
checks AS (
  SELECT win, idx, p0, p1, signal,
    CASE WHEN signal <> 'none' THEN min(win * {w}) OVER (PARTITION BY run ORDER BY win) END AS train_from
  FROM (SELECT *, sum(opens) OVER (ORDER BY win) AS run FROM (
    SELECT *, CASE WHEN coalesce(lag(signal) OVER (ORDER BY win) <> 'warning', TRUE) THEN 1 ELSE 0 END AS opens
    FROM signalled)))"""


def rises(delta: float = 0.01, warmup: int = 1000, levels: int = 15) -> str:
    """CTE rises(model, idx, width, error_rate) over scored(model, idx, label, pred): a recursive walk over the tests of the
    adaptive window, `c` holds its buckets per level, smallest first. Sums of buckets are differences of prefix sums."""
    span = f"range(1, {levels + 1})"
    width = f"CAST(list_sum(list_transform({span}, lambda i: c[i] * (1 << (i - 1)))) AS BIGINT)"
    # what a level receives, what it merges away when it would hold more than five, and what goes up
    grown = f"""list_reduce(list_transform({span}, lambda i: [c[i]]), lambda acc, x: list_concat(
      CAST([greatest(0, (x[1] + acc[1] - 4) // 2)] AS BIGINT[]), list_append(acc[2:], x[1] + acc[1] - 2 * greatest(0, (x[1] + acc[1] - 4) // 2))),
      CAST([32] AS BIGINT[]))[2:]"""
    newest = f"""list_transform({span}, lambda i: CAST(coalesce(list_sum(list_transform(range(1, i), lambda q: c[q] * (1 << (q - 1)))), 0) AS BIGINT))"""
    return f"""
errors AS (
  SELECT model, max(idx) - {warmup} + 1 AS n, list_prepend(0, list(CAST(s AS BIGINT) ORDER BY idx)) AS sums FROM (
    SELECT model, idx, sum(CAST(pred <> label AS INTEGER)) OVER (PARTITION BY model ORDER BY idx) AS s FROM scored WHERE idx >= {warmup}) GROUP BY model),
walk AS (
  SELECT model, CAST(0 AS BIGINT) AS t, CAST(list_transform({span}, lambda i: 0) AS BIGINT[]) AS c, FALSE AS hit FROM errors
  UNION ALL
  SELECT model, t, c, hit_now FROM (
    SELECT model, t, c,
      len(list_filter(borders, lambda m: m >= 5 AND w - m >= 5 AND
        abs((total - sums[t + 1] + sums[t - m + 1]) / CAST(w - m AS DOUBLE) - (sums[t + 1] - sums[t - m + 1]) / CAST(m AS DOUBLE)) >
        sqrt(2 * (CAST(1 AS DOUBLE) / (w - m - 4) + CAST(1 AS DOUBLE) / (m - 4)) * (total / CAST(w AS DOUBLE)) * (1 - total / CAST(w AS DOUBLE)) * term)
        + CAST(2 AS DOUBLE) / 3 * (CAST(1 AS DOUBLE) / (w - m - 4) + CAST(1 AS DOUBLE) / (m - 4)) * term)) > 0 AND (hit OR w > 10) AS hit_now
    FROM (
      SELECT *, sums[t + 1] - sums[t - w + 1] AS total, ln(2 * ln(CAST(greatest(w, 2) AS DOUBLE)) / {delta}) AS term,
        flatten(list_transform({span}, lambda i: list_transform(range(1, c[i] + 1), lambda j: newer[i] + j * (1 << (i - 1))))) AS borders
      FROM (
        SELECT *, {width} AS w, {newest} AS newer FROM (
          SELECT k.model, e.sums, k.hit, CASE WHEN k.hit THEN k.t ELSE k.t + 32 END AS t, CASE WHEN k.hit
            THEN list_transform({span}, lambda i: k.c[i] - CAST(i = list_max(list_transform({span}, lambda q: CASE WHEN k.c[q] > 0 THEN q ELSE 0 END)) AS BIGINT))
            ELSE {grown.replace("c[i]", "k.c[i]")} END AS c
          FROM walk k JOIN errors e USING (model) WHERE k.hit OR k.t + 32 <= e.n))))),
tests AS (SELECT model, t, max({width}) AS w1, min({width}) AS w2, bool_or(hit) AS hit FROM walk WHERE t > 0 GROUP BY model, t),
rises AS (
  SELECT model, {warmup} + t - 1 AS idx, w2 AS width, round((sums[t + 1] - sums[t - w2 + 1]) / CAST(w2 AS DOUBLE), 4) AS error_rate
  FROM tests JOIN errors USING (model)
  WHERE hit AND (sums[t + 1] - sums[t - w2 + 1]) / CAST(w2 AS DOUBLE) > (sums[t] - sums[t - w1 + 1]) / CAST(greatest(w1 - 1, 1) AS DOUBLE))"""


def enhanced(models: dict[str, str], w: str, cooldown: int, min_rebuild: int, buffer_rows: int, rounds: int) -> str:
    """CTEs enhanced(model, idx, label, pred, lam) and enhanced_events, for models (name: fusion) that rebuild on both channels.

    Needs rows, words and checks. Each of `rounds` unrolled rounds scores all rows by the rebuilds found so far, walks the
    error window over them, and adds the first signal behind these rebuilds that passes gate and cooldown.
    """
    names = ", ".join(f"('{m}', '{fusion}')" for m, fusion in models.items())
    parts = [f"""
fusions AS (SELECT * FROM (VALUES {names}) AS v(model, fusion)),
acts_0 AS (SELECT model, CAST(-1 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS detector, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS b FROM fusions)"""]
    for r in range(rounds):
        parts.append(f"""
scored_{r} AS MATERIALIZED (
  WITH segs AS (
    SELECT model, b, CAST(0 AS DOUBLE) AS lam, CAST(1 AS DOUBLE) AS alpha, idx + 1 AS lo, hi FROM (
      SELECT *, coalesce(lead(idx) OVER (PARTITION BY model ORDER BY place), (SELECT count(*) FROM rows) - 1) AS hi FROM acts_{r}) WHERE idx < hi),
  {SCORED.strip()}
  SELECT model, idx, label, pred, lam FROM scored),
signals_{r} AS MATERIALIZED (
  WITH RECURSIVE scored AS (SELECT * FROM scored_{r}),
  {rises().strip()},
  raised AS (
    SELECT model, fusion, 'adwin' AS detector, 2 * idx AS place, idx, 'change' AS kind, width, error_rate, greatest(idx + 1 - least(greatest(width, {min_rebuild}), {buffer_rows}), 0) AS b
    FROM rises JOIN fusions USING (model) WHERE fusion <> 'vocab_only'
    UNION ALL SELECT model, fusion, 'vocab', 2 * idx + 1, idx, signal, NULL, NULL, train_from FROM checks, fusions WHERE fusion <> 'adwin_only' AND signal <> 'none')
  SELECT *, CASE WHEN fusion <> 'and' THEN kind WHEN idx - CASE detector
      WHEN 'adwin' THEN max(CASE WHEN detector = 'vocab' THEN idx END) OVER p ELSE max(CASE WHEN detector = 'adwin' THEN idx END) OVER p END <= {w} THEN 'change' ELSE 'none' END AS gated
  FROM raised WINDOW p AS (PARTITION BY model ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
acts_{r + 1} AS MATERIALIZED (
  SELECT * FROM acts_{r}
  UNION ALL SELECT s.model, s.place, s.detector, s.idx, s.b FROM signals_{r} s
  WHERE s.gated = 'change' AND s.place > (SELECT max(a.place) FROM acts_{r} a WHERE a.model = s.model)
    AND s.idx >= coalesce((SELECT max(a.idx) + {cooldown} FROM acts_{r} a WHERE a.model = s.model AND a.detector = s.detector), 0)
  QUALIFY row_number() OVER (PARTITION BY s.model ORDER BY s.place) = 1)""")
    last = rounds - 1
    parts.append(f"""
enhanced AS (SELECT model, idx, label, pred, lam FROM scored_{last}),
enhanced_events AS (
  SELECT s.model, s.idx, s.detector, s.kind, a.place IS NOT NULL AS acted, CAST(NULL AS BIGINT) AS rebuild_size, s.width, s.error_rate
  FROM signals_{last} s LEFT JOIN acts_{rounds} a USING (model, place)
  UNION ALL SELECT model, idx, detector, 'rebuild', NULL, idx - b + 1, NULL, NULL FROM acts_{rounds} WHERE place >= 0)""")
    return ",".join(parts)
