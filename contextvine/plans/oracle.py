"""DuckDB SQL for the registered queries, written independently from per-position tables."""

from __future__ import annotations

_SEQS = """seqs AS (
  SELECT CAST(user_id AS VARCHAR) AS seq_id, string_agg(translate(substr(event_type, 1, 1), 'cpevs', 'ACGTN'), '' ORDER BY ts, event_id) AS seq
  FROM events GROUP BY user_id)"""
_DOCS = """seqs AS (
  SELECT CAST(doc_id AS VARCHAR) AS seq_id,
         regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT'), '[^ACGT]', 'N', 'g') AS seq
  FROM documents WHERE text IS NOT NULL)"""


def _document_training(depth: int, count: int, threshold: float) -> str:
    """The same over long texts: words come from neighbouring symbols, so no row holds a text."""
    after = " || ".join(f"coalesce(lead(c, {k}) OVER w, '')" for k in range(1, depth + 1))
    words = f"""
letters AS (SELECT seq_id, unnest(string_split(seq, '')) AS c, unnest(range(1, length(seq) + 1)) AS i FROM seqs WHERE seq <> ''),
tails AS (SELECT seq_id, t, count(*) AS n FROM (SELECT seq_id, string_split(c || {after}, 'N')[1] AS t FROM letters WINDOW w AS (PARTITION BY seq_id ORDER BY i)) WHERE t <> '' GROUP BY 1, 2),
words AS (SELECT seq_id AS model_id, left(t, CAST(k AS INT)) AS word, CAST(sum(n) AS BIGINT) AS n FROM tails, (SELECT unnest(range(1, {depth + 2})) AS k) WHERE length(t) >= k GROUP BY 1, 2),"""
    rest = _training(depth, count, threshold)
    return words + rest[rest.index("\nnodes AS") :]


def _level_training(depth: int, count: int, threshold: float, step: int = 4) -> str:
    """The same to a large depth: a position's letters are counted on only where their beginning has support."""
    after = " || ".join(f"coalesce(lead(c, {k}) OVER w, '')" for k in range(1, depth + 1))
    out = f"""
letters AS (SELECT seq_id, unnest(string_split(seq, '')) AS c, unnest(range(1, length(seq) + 1)) AS i FROM seqs WHERE seq <> ''),
alive0 AS MATERIALIZED (SELECT seq_id, string_split(c || {after}, 'N')[1] AS t FROM letters WINDOW w AS (PARTITION BY seq_id ORDER BY i)),"""
    levels = []
    for start in range(0, depth + 1, step):
        stop = min(depth + 1, start + step)
        out += f"""
words{start} AS MATERIALIZED (SELECT seq_id AS model_id, left(t, CAST(k AS INT)) AS word, count(*) AS n FROM alive{start}, (SELECT unnest(range({start + 1}, {stop + 1})) AS k) WHERE length(t) >= k GROUP BY 1, 2),
alive{stop} AS MATERIALIZED (SELECT a.* FROM alive{start} a SEMI JOIN (SELECT model_id, word FROM words{start} WHERE length(word) = {stop} AND n >= {count}) f ON f.model_id = a.seq_id AND f.word = left(a.t, {stop})),"""
        levels.append(f"SELECT * FROM words{start}")
    out += f"""
words AS ({" UNION ALL ".join(levels)}),"""
    rest = _training(depth, count, threshold)
    return out + rest[rest.index("\nnodes AS") :]


def _training(depth: int, count: int, threshold: float) -> str:
    return f"""
pos AS (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs),
words AS (
  SELECT seq_id AS model_id, substr(seq, i, k) AS word, count(*) AS n
  FROM pos, (SELECT unnest(range(1, {depth + 2})) AS k)
  WHERE i + k - 1 <= length(seq) AND NOT contains(substr(seq, i, k), 'N') GROUP BY 1, 2),
nodes AS (
  SELECT model_id, word AS context, n AS count FROM words WHERE length(word) <= {depth} AND n >= {count}
  UNION ALL SELECT seq_id, '', length(seq) FROM seqs),
fol AS (
  SELECT model_id, left(word, length(word) - 1) AS context,
         CAST(sum(CASE WHEN right(word, 1) = 'A' THEN n ELSE 0 END) AS BIGINT) AS n_a, CAST(sum(CASE WHEN right(word, 1) = 'C' THEN n ELSE 0 END) AS BIGINT) AS n_c,
         CAST(sum(CASE WHEN right(word, 1) = 'G' THEN n ELSE 0 END) AS BIGINT) AS n_g, CAST(sum(CASE WHEN right(word, 1) = 'T' THEN n ELSE 0 END) AS BIGINT) AS n_t
  FROM words WHERE length(word) > 1 OR n >= {count} GROUP BY 1, 2),
nums AS (
  SELECT nodes.model_id, nodes.context, nodes.count, coalesce(n_a, 0) AS n_a, coalesce(n_c, 0) AS n_c, coalesce(n_g, 0) AS n_g, coalesce(n_t, 0) AS n_t
  FROM nodes LEFT JOIN fol ON fol.model_id = nodes.model_id AND fol.context = nodes.context),
probs AS (
  SELECT model_id, context, count, (n_a + 1) / CAST(n_a + n_c + n_g + n_t + 4 AS DOUBLE) AS p_a, (n_c + 1) / CAST(n_a + n_c + n_g + n_t + 4 AS DOUBLE) AS p_c,
         (n_g + 1) / CAST(n_a + n_c + n_g + n_t + 4 AS DOUBLE) AS p_g, (n_t + 1) / CAST(n_a + n_c + n_g + n_t + 4 AS DOUBLE) AS p_t FROM nums),
delta AS (
  SELECT c.model_id, c.context, c.count, c.count * (c.p_a * ln(c.p_a / p.p_a) + c.p_c * ln(c.p_c / p.p_c) + c.p_g * ln(c.p_g / p.p_g) + c.p_t * ln(c.p_t / p.p_t)) AS delta
  FROM probs c JOIN probs p ON p.model_id = c.model_id AND p.context = substr(c.context, 2) WHERE c.context <> ''),
sub AS (
  SELECT model_id, u AS context, max(delta) AS most FROM (SELECT model_id, delta, unnest(list_transform(range(1, length(context) + 1), lambda k: right(context, CAST(k AS INT)))) AS u FROM delta) GROUP BY 1, 2),
models AS (
  SELECT probs.* FROM probs LEFT JOIN sub ON sub.model_id = probs.model_id AND sub.context = probs.context WHERE probs.context = '' OR sub.most >= {threshold})"""


_MODELS = f"WITH {_SEQS},{_training(3, 2, 0.5)}"
_R = "round({x}, 6) + 0.0"


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


_PS = ", ".join(_r(p, p) for p in ("p_a", "p_c", "p_g", "p_t"))
_PSM = ", ".join(_r(f"m.{p}", p) for p in ("p_a", "p_c", "p_g", "p_t"))
_CHILDREN = """
kids AS (
  SELECT m.model_id, m.context, m.count, (SELECT count(*) FROM models c WHERE c.model_id = m.model_id AND c.context <> '' AND substr(c.context, 2) = m.context) AS n_children FROM models m)"""
_POSITIONS = """
posn AS (SELECT seq_id, i - 1 AS pos, substr(seq, greatest(i - 3, 1), i - greatest(i - 3, 1)) AS probe, substr(seq, i, 1) AS symbol FROM pos)"""


def _state(name: str, probes: str, tied: bool, table: str = "models") -> str:
    """Closest states of a CTE of probes."""
    best = ", ".join(f"arg_max(m.{c}, length(m.context)) AS {c}" for c in ("context", "count", "p_a", "p_c", "p_g", "p_t"))
    ends = f"(SELECT *, unnest(list_transform(range(0, length(probe) + 1), lambda k: CASE WHEN k = 0 THEN '' ELSE right(probe, CAST(k AS INT)) END)) AS u FROM {probes})"
    on = "m.model_id = p.model_id AND m.context = p.u" if tied else "m.context = p.u"
    return f"""
{name} AS (SELECT m.model_id, p.probe, {best} FROM {ends} p JOIN {table} m ON {on} GROUP BY m.model_id, p.probe)"""


_OWN = _POSITIONS + "," + """
own AS (SELECT DISTINCT seq_id AS model_id, probe FROM posn),""" + _state("st", "own", True)
_LN = "CASE symbol WHEN 'A' THEN ln(p_a) WHEN 'C' THEN ln(p_c) WHEN 'G' THEN ln(p_g) WHEN 'T' THEN ln(p_t) ELSE 0 END"
_PICK = "CASE symbol WHEN 'A' THEN p_a WHEN 'C' THEN p_c WHEN 'G' THEN p_g WHEN 'T' THEN p_t ELSE 0 END"
_SCORED = f"""
sc AS (SELECT posn.seq_id, st.model_id, posn.pos, posn.symbol, {_LN} AS s FROM posn JOIN st ON st.model_id = posn.seq_id AND st.probe = posn.probe)"""
_BG = _OWN + "," + """
want AS (SELECT *, CASE WHEN 1 < length(context) THEN right(context, 1) ELSE '' END AS b FROM st),
bgp AS (SELECT DISTINCT model_id, b AS probe FROM want),""" + _state("bg", "bgp", True) + """,
sc AS (
  SELECT posn.seq_id, w.model_id, posn.pos, posn.symbol, CASE posn.symbol
    WHEN 'A' THEN ln(w.p_a) - ln(sqrt(bg.p_a)) WHEN 'C' THEN ln(w.p_c) - ln(sqrt(bg.p_c)) WHEN 'G' THEN ln(w.p_g) - ln(sqrt(bg.p_g)) WHEN 'T' THEN ln(w.p_t) - ln(sqrt(bg.p_t)) ELSE 0 END AS s
  FROM posn JOIN want w ON w.model_id = posn.seq_id AND w.probe = posn.probe JOIN bg ON bg.model_id = w.model_id AND bg.probe = w.b)"""
_NLL = f"SELECT seq_id, model_id, {_r('-sum(s) / sum(CASE WHEN s <> 0 THEN 1 ELSE 0 END)', 'nll')} FROM sc WHERE symbol <> 'N' GROUP BY seq_id, model_id"


def _windows(sizes: tuple[int, ...], source: str = "sc") -> str:
    parts = []
    for w in sizes:
        frame = f"OVER (PARTITION BY seq_id, model_id ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        n = f"sum(CASE WHEN s <> 0 THEN 1 ELSE 0 END) {frame}"
        parts.append(f"SELECT seq_id, model_id, {w} AS window_size, pos, CASE WHEN {n} = 0 THEN -1.0 ELSE -(sum(s) {frame}) / {n} END AS nll FROM {source}")
    return " UNION ALL ".join(parts)


def _pairs(value: str, sums: str, missing: str) -> str:
    return f""",
ids AS (SELECT a.model_id AS left_id, b.model_id AS right_id FROM (SELECT DISTINCT model_id FROM models) a, (SELECT DISTINCT model_id FROM models) b),
sums AS ({sums})
SELECT ids.left_id, ids.right_id, round(CASE WHEN s.left_id IS NULL THEN {missing} ELSE {value} END, 6) + 0.0 AS value
FROM ids LEFT JOIN sums s ON s.left_id = ids.left_id AND s.right_id = ids.right_id"""


_DOT = """SELECT l.model_id AS left_id, r.model_id AS right_id, sum(l.a * r.a + l.c * r.c + l.g * r.g + l.t * r.t) AS dot,
  sum(l.a * l.a + l.c * l.c + l.g * l.g + l.t * l.t) AS l2, sum(r.a * r.a + r.c * r.c + r.g * r.g + r.t * r.t) AS r2
  FROM comp l JOIN comp r ON l.context = r.context GROUP BY 1, 2"""
_COS = "dot / (sqrt(l2) * sqrt(r2))"
_HALF = f"CASE WHEN l2 > 0 AND r2 > 0 THEN 0.5 * (1 - {_COS}) ELSE 1.0 END"
_ANGLE = f"CASE WHEN l2 > 0 AND r2 > 0 THEN CASE WHEN {_COS} > 1 THEN 0.0 ELSE 2 * acos(greatest(least({_COS}, 1.0), -1.0)) / pi() END ELSE 1.0 END"
_CVDIST = f"CASE WHEN l2 > 0 AND r2 > 0 THEN (1 - {_COS}) / 2 ELSE 0.0 END"
_RAW = "comp AS (SELECT model_id, context, p_a AS a, p_c AS c, p_g AS g, p_t AS t FROM models)"


def _star(b: int) -> str:
    """Components over the root of the background's probability, 0 where the background is missing."""
    cols = ", ".join(f"CASE WHEN coalesce(g.p_{x}, 0) > 0 THEN m.p_{x} / sqrt(g.p_{x}) ELSE 0 END AS {x}" for x in "acgt")
    bg = "''" if b == 0 else f"CASE WHEN length(m.context) <= {b} THEN m.context ELSE right(m.context, {b}) END"
    return f"comp AS (SELECT m.model_id, m.context, {cols} FROM models m LEFT JOIN models g ON g.model_id = m.model_id AND g.context = {bg} WHERE length(m.context) > {b})"


_RELATIVE = "(SELECT m.model_id, m.context, " + ", ".join(f"CASE WHEN g.p_{x} > 0 THEN (m.p_{x} - g.p_{x}) / g.p_{x} ELSE 0 END AS {x}" for x in "acgt") + " FROM {states} m JOIN bg g ON g.model_id = m.model_id AND g.probe = right(m.state, 1))"
_CV = """self AS (SELECT *, context AS state FROM models),
bgp AS (SELECT DISTINCT model_id, right(context, 1) AS probe FROM models),""" + _state("bg", "bgp", True) + ",\ncomp AS " + _RELATIVE.format(states="self")
_LETTERS = "(SELECT unnest(['A', 'C', 'G', 'T']) AS x)"


def _estimated(k: int) -> str:
    product = f"SELECT {' || '.join(f'l{i}.x' for i in range(k))} AS probe FROM {', '.join(f'{_LETTERS} l{i}' for i in range(k))}"
    return f"every AS ({product})," + _state("est", "every", False) + """,
named AS (SELECT model_id, probe AS context, context AS state, count, p_a, p_c, p_g, p_t FROM est),
bgp AS (SELECT DISTINCT model_id, right(state, 1) AS probe FROM named),""" + _state("bg", "bgp", True) + ",\ncomp AS " + _RELATIVE.format(states="named")


def _chances(k: int, table: str = "models", prefix: str = "") -> str:
    """Probability of each word of k symbols from its start."""
    product = f"SELECT {' || '.join(f'l{i}.x' for i in range(k))} AS word FROM {', '.join(f'{_LETTERS} l{i}' for i in range(k))}"
    return f"""{prefix}all_w AS ({product}),
{prefix}steps AS (SELECT word, left(word, CAST(i AS INT)) AS probe, substr(word, i + 1, 1) AS symbol FROM {prefix}all_w, (SELECT unnest(range(0, {k})) AS i)),
{prefix}prb AS (SELECT DISTINCT probe FROM {prefix}steps),""" + _state(f"{prefix}ws", f"{prefix}prb", False, table) + f""",
{prefix}chance AS (SELECT ws.model_id, word, exp(sum({_LN})) AS p FROM {prefix}steps s JOIN {prefix}ws ws ON ws.probe = s.probe GROUP BY 1, 2)"""


_ROOTED = """rooted AS (SELECT m.*, r.count AS root, r.p_a AS r_a, r.p_c AS r_c, r.p_g AS r_g, r.p_t AS r_t FROM models m JOIN models r ON r.model_id = m.model_id AND r.context = '')"""
_D2STAR = _ROOTED + """,
expect AS (SELECT *, (root - length(context)) * pow(r_a, length(context) - length(replace(context, 'A', ''))) * pow(r_c, length(context) - length(replace(context, 'C', '')))
  * pow(r_g, length(context) - length(replace(context, 'G', ''))) * pow(r_t, length(context) - length(replace(context, 'T', ''))) AS e FROM rooted),
comp AS (SELECT model_id, context, """ + ", ".join(f"CASE WHEN e * r_{x} > 0 THEN (count * p_{x} - e * r_{x}) / sqrt(CASE WHEN e * r_{x} > 0 THEN e * r_{x} END) ELSE 0 END AS {x}" for x in "acgt") + " FROM expect)"


def _terms(term: str, join: str, extra: str = "") -> str:
    return f"SELECT l.model_id AS left_id, r.model_id AS right_id, {term}{extra} FROM {join} l JOIN {join} r ON l.context = r.context GROUP BY 1, 2"


_JS = " + ".join(f"0.5 * l.{x} * ln(l.{x} / ((l.{x} + r.{x}) / 2)) + 0.5 * r.{x} * ln(r.{x} / ((l.{x} + r.{x}) / 2))" for x in "acgt")
_KBB = " + ".join(f"(l.{x} - r.{x}) * ln(l.{x} / r.{x})" for x in "acgt")
_SUMS = ", ".join(f"sum({' + '.join(e.format(x=x) for x in 'acgt')}) AS {n}" for n, e in (("sl", "l.{x}"), ("sr", "r.{x}"), ("lr", "l.{x} * r.{x}"), ("ll", "l.{x} * l.{x}"), ("rr", "r.{x} * r.{x}")))
_LONG = "SELECT model_id, context, 'A' AS symbol, {a} AS component FROM {t} UNION ALL SELECT model_id, context, 'C', {c} FROM {t} UNION ALL SELECT model_id, context, 'G', {g} FROM {t} UNION ALL SELECT model_id, context, 'T', {u} FROM {t}"


def _long(source: str, form: str = "round({x}, 6) + 0.0") -> str:
    return _LONG.format(t=source, **{k: form.format(x=x) for k, x in zip("acgu", "acgt")})


_NEAREST = _star(0) + """,
miss AS (SELECT c.*, i.model_id AS other FROM comp c, (SELECT DISTINCT model_id FROM models) i WHERE NOT EXISTS (SELECT 1 FROM models m WHERE m.model_id = i.model_id AND m.context = c.context)),
np AS (SELECT DISTINCT other AS model_id, context AS probe FROM miss),""" + _state("ns", "np", True) + """,
nc AS (SELECT ns.model_id, ns.probe, """ + ", ".join(f"ns.p_{x} / sqrt(g.p_{x}) AS {x}" for x in "acgt") + """ FROM ns JOIN models g ON g.model_id = ns.model_id AND g.context = '')"""
_NEAREST_SUMS = f"""SELECT left_id, right_id, sum(dot) AS dot, sum(l2) AS l2, sum(r2) AS r2 FROM ({_DOT} UNION ALL
  SELECT l.model_id, l.other, sum(l.a * r.a + l.c * r.c + l.g * r.g + l.t * r.t), sum(l.a * l.a + l.c * l.c + l.g * l.g + l.t * l.t), sum(r.a * r.a + r.c * r.c + r.g * r.g + r.t * r.t)
  FROM miss l JOIN nc r ON r.model_id = l.other AND r.probe = l.context GROUP BY 1, 2) GROUP BY 1, 2"""

_GRID = f"""WITH {_SEQS},{_training(3, 2, 0.0)},{_POSITIONS},
grid AS (SELECT * FROM (SELECT unnest([2, 4]) AS min_count), (SELECT unnest([2, 3]) AS max_depth), (SELECT unnest([0.5, 1.5])::DOUBLE AS threshold)),
gd AS (SELECT min_count, max_depth, model_id, unnest(list_transform(range(1, length(context) + 1), lambda k: right(context, CAST(k AS INT)))) AS context, delta
  FROM delta, (SELECT DISTINCT min_count, max_depth FROM grid) WHERE count >= min_count AND length(context) <= max_depth),
gs AS (SELECT min_count, max_depth, model_id, context, max(delta) AS most FROM gd GROUP BY ALL),
gm AS (
  SELECT g.min_count, g.max_depth, g.threshold, p.* FROM gs JOIN grid g ON g.min_count = gs.min_count AND g.max_depth = gs.max_depth AND gs.most >= g.threshold
    JOIN probs p ON p.model_id = gs.model_id AND p.context = gs.context
  UNION ALL SELECT g.min_count, g.max_depth, g.threshold, p.* FROM grid g, probs p WHERE p.context = ''),
gk AS (SELECT min_count, max_depth, threshold, model_id, substr(context, 2) AS context, count(*) AS n_children FROM gm WHERE context <> '' GROUP BY ALL),
gz AS (
  SELECT gm.min_count, gm.max_depth, gm.threshold, gm.model_id, CAST(3 * sum(CASE WHEN coalesce(n_children, 0) < 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_params, min(gm.count) AS observed_min_count,
         max(length(gm.context)) AS observed_max_depth
  FROM gm LEFT JOIN gk USING (min_count, max_depth, threshold, model_id, context) GROUP BY 1, 2, 3, 4),
own AS (SELECT DISTINCT seq_id AS model_id, probe FROM posn),
ends AS (SELECT *, unnest(list_transform(range(0, length(probe) + 1), lambda k: CASE WHEN k = 0 THEN '' ELSE right(probe, CAST(k AS INT)) END)) AS u FROM own),
gst AS (
  SELECT m.min_count, m.max_depth, m.threshold, m.model_id, e.probe, {", ".join(f"arg_max(m.{c}, length(m.context)) AS {c}" for c in ("p_a", "p_c", "p_g", "p_t"))}
  FROM ends e JOIN gm m ON m.model_id = e.model_id AND m.context = e.u GROUP BY 1, 2, 3, 4, 5),
gl AS (SELECT st.min_count, st.max_depth, st.threshold, st.model_id, sum({_LN}) AS ll FROM posn JOIN gst st ON st.model_id = posn.seq_id AND st.probe = posn.probe WHERE symbol <> 'N' GROUP BY 1, 2, 3, 4),
result AS (
  SELECT gz.model_id AS seq_id, gz.min_count, gz.max_depth, gz.threshold, n_params * ln(length(seq)) - 2 * ll AS bic_score, 2 * n_params - 2 * ll AS aic_score,
         2 * n_params - 2 * ll + CASE WHEN length(seq) - n_params - 1 <> 0 THEN (2 * n_params * n_params + 2 * n_params) / CAST(length(seq) - n_params - 1 AS DOUBLE) END AS aicc_score,
         ll AS log_likelihood, n_params, observed_min_count, observed_max_depth
  FROM gz JOIN gl USING (min_count, max_depth, threshold, model_id) JOIN seqs ON seqs.seq_id = gz.model_id)"""

_FEWER = "fewer AS (SELECT probs.* FROM probs LEFT JOIN sub ON sub.model_id = probs.model_id AND sub.context = probs.context WHERE probs.context = '' OR sub.most >= 1.0)"
_WORD_SCORES = _chances(4) + ", scored AS (SELECT c.model_id, c.word, ln(c.p) AS l, c.p * m.count AS f FROM chance c JOIN models m ON m.model_id = c.model_id AND m.context = '')"


def _dot(a: str, b: str) -> str:
    return " + ".join(f"{a}.p_{x} * {b}.p_{x}" for x in "acgt")


ORACLE_SQL: dict[str, str] = {
    "word_counts": f"{_MODELS} SELECT model_id, word, n FROM words",
    "document_word_counts": f"WITH {_DOCS},{_document_training(2, 4, 3.9075)} SELECT word, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_sequences FROM words GROUP BY word",
    "document_models": f"WITH {_DOCS},{_document_training(2, 4, 3.9075)} SELECT model_id, context, count, {_PS} FROM models",
    "level_wise_models": f"WITH {_DOCS},{_level_training(15, 100, 3.9075)} SELECT model_id, context, count, {_PS} FROM models",
    "support_prune": f"{_MODELS} SELECT model_id, context, count FROM nodes",
    "forward_counts": f"{_MODELS} SELECT * FROM fol",
    "next_probabilities": f"{_MODELS} SELECT model_id, context, count, {_PS} FROM probs",
    "kl_delta": f"{_MODELS} SELECT model_id, context, count, {_r('delta', 'delta')} FROM delta",
    "cutoff_prune": f"{_MODELS} SELECT model_id, context, count, {_PS} FROM models",
    "parameters_prune": f"""WITH {_SEQS},{_training(3, 2, -1e300)},{_CHILDREN},
full_t AS (SELECT model_id, sum(CASE WHEN n_children < 4 THEN 1 ELSE 0 END) AS n_terminal FROM kids GROUP BY 1),
o AS (SELECT m.model_id, m.context, m.count, sub.most, length(m.context) AS depth, count(*) OVER s AS sib, row_number() OVER (PARTITION BY m.model_id, substr(m.context, 2) ORDER BY round(sub.most, 9), length(m.context) DESC, m.context) AS nth
  FROM models m JOIN sub ON sub.model_id = m.model_id AND sub.context = m.context WHERE m.context <> '' WINDOW s AS (PARTITION BY m.model_id, substr(m.context, 2))),
f AS (SELECT o.*, n_terminal - coalesce(sum(CASE WHEN sib = 4 AND nth = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY o.model_id ORDER BY round(most, 9), depth DESC, context ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM o JOIN full_t ON full_t.model_id = o.model_id)
SELECT model_id, context, count FROM f WHERE before * 3 <= 24 UNION ALL SELECT model_id, context, count FROM models WHERE context = ''""",
    "reprune_support": f"{_MODELS} SELECT model_id, context, count, {_PS} FROM models WHERE context = '' OR (count >= 4 AND length(context) <= 2)",
    "reprune_similarity": f"WITH {_SEQS},{_training(3, 2, 1.0)} SELECT model_id, context, count, {_PS} FROM models",
    "pst_leaves": f"{_MODELS},{_CHILDREN} SELECT model_id, context, count FROM kids WHERE n_children = 0",
    "terminal_nodes": f"{_MODELS},{_CHILDREN} SELECT model_id, context, count FROM kids WHERE n_children < 4",
    "model_stats": f"""{_MODELS},{_CHILDREN} SELECT model_id, count(*) AS n_nodes, CAST(sum(CASE WHEN n_children < 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_terminal,
  CAST(3 * sum(CASE WHEN n_children < 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_params, max(length(context)) AS max_order, min(count) AS observed_min_count FROM kids GROUP BY 1""",
    "pst_children": f"{_MODELS} SELECT model_id, context, count FROM models WHERE length(context) = 2 AND right(context, 1) = 'T'",
    "pst_subtree": f"{_MODELS} SELECT model_id, context, count FROM models WHERE right(context, 1) = 'A'",
    "sorted_contexts": f"{_MODELS} SELECT model_id, string_agg(context, ',' ORDER BY context) AS contexts FROM models GROUP BY 1",
    "estimated_child_counts": f"{_MODELS} SELECT model_id, context, count, " + ", ".join(f"CAST(round(p_{x} * (count + 4) - 1) AS BIGINT) AS n_{x}" for x in "acgt") + " FROM models",
    "diagnostics": f"""{_MODELS},{_CHILDREN} SELECT d.model_id, d.context, d.count, k.context IS NOT NULL AS included, coalesce(n_children = 0, false) AS is_leaf, coalesce(n_children < 4, false) AS is_terminal
  FROM probs d LEFT JOIN kids k ON k.model_id = d.model_id AND k.context = d.context""",
    "tree_text_round_trip": f"""{_MODELS}, est AS (SELECT model_id, context, count, {", ".join(f"round(p_{x} * (count + 4) - 1) AS e_{x}" for x in "acgt")} FROM models)
SELECT model_id, context, count, {", ".join(_r(f"(e_{x} + 1) / (e_a + e_c + e_g + e_t + 4)", f"p_{x}") for x in "acgt")} FROM est""",
    "reprune_loaded": f"""{_MODELS}, est AS (SELECT model_id, context, count, {", ".join(f"round(p_{x} * (count + 4) - 1) AS e_{x}" for x in "acgt")} FROM models),
read AS (SELECT model_id, context, count, {", ".join(f"(e_{x} + 1) / (e_a + e_c + e_g + e_t + 4) AS p_{x}" for x in "acgt")} FROM est),
again AS (SELECT c.model_id, c.context, c.count * ({" + ".join(f"c.p_{x} * ln(c.p_{x} / p.p_{x})" for x in "acgt")}) AS delta FROM read c JOIN read p ON p.model_id = c.model_id AND p.context = substr(c.context, 2) WHERE c.context <> ''),
kept AS (SELECT DISTINCT model_id, unnest(list_transform(range(1, length(context) + 1), lambda k: right(context, CAST(k AS INT)))) AS context FROM again WHERE delta >= 1.0)
SELECT read.model_id, read.context, count, {", ".join(_r(f"p_{x}", f"p_{x}") for x in "acgt")} FROM read LEFT JOIN kept ON kept.model_id = read.model_id AND kept.context = read.context WHERE read.context = '' OR kept.context IS NOT NULL""",
    "closest_state": f"{_MODELS},{_OWN} SELECT model_id, probe, context, count, {_PS} FROM st",
    "log_likelihood": f"""{_MODELS},{_OWN},{_SCORED} SELECT sc.seq_id, model_id, {_r("sum(CASE WHEN symbol <> 'N' THEN s ELSE 0 END)", "ll")}, CAST(sum(CASE WHEN symbol <> 'N' AND s <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_scored,
  length(any_value(seq)) AS length FROM sc JOIN seqs ON seqs.seq_id = sc.seq_id GROUP BY 1, 2""",
    "likelihood": f"{_MODELS},{_OWN},{_SCORED} SELECT seq_id, model_id, {_r('sum(s)', 'log_likelihood')} FROM sc GROUP BY 1, 2",
    "word_likelihood": f"{_MODELS}, {_chances(3)} SELECT model_id, word, {_r('ln(p)', 'log_p')} FROM chance",
    "automaton": f"""{_MODELS}, q AS (SELECT DISTINCT model_id, left(context, CAST(k AS INT)) AS state FROM (SELECT model_id, context, unnest(range(0, length(context) + 1)) AS k FROM models)),
step AS (SELECT model_id, state, x, unnest(list_transform(range(0, length(state || x) + 1), lambda k: CASE WHEN k = 0 THEN '' ELSE right(state || x, CAST(k AS INT)) END)) AS u FROM q, (SELECT unnest(['', 'A', 'C', 'G', 'T']) AS x)),
went AS (SELECT step.model_id, step.state, x, arg_max(u, length(u)) AS u FROM step JOIN q t ON t.model_id = step.model_id AND t.state = u WHERE x <> '' GROUP BY 1, 2, 3),
held AS (SELECT step.model_id, step.state, arg_max(u, length(u)) AS context FROM step JOIN models m ON m.model_id = step.model_id AND m.context = u WHERE x = '' GROUP BY 1, 2)
SELECT held.model_id, held.state, held.context, {", ".join(f"max(CASE WHEN x = '{x.upper()}' THEN u END) AS next_{x}" for x in "acgt")} FROM held JOIN went ON went.model_id = held.model_id AND went.state = held.state GROUP BY 1, 2, 3""",
    "nll_automaton": f"{_MODELS},{_OWN},{_SCORED} {_NLL}",
    "nll": f"{_MODELS},{_OWN},{_SCORED} {_NLL}",
    "nll_max_adjusted": f"{_MODELS},{_OWN},{_SCORED.replace(_LN, _PICK)} {_NLL}",
    "nll_background": f"{_MODELS},{_BG} {_NLL}",
    "score_matrix": f"{_MODELS},{_POSITIONS}, pr AS (SELECT DISTINCT probe FROM posn),{_state('st', 'pr', False)}, sc AS (SELECT posn.seq_id, st.model_id, posn.symbol, {_LN} AS s FROM posn JOIN st ON st.probe = posn.probe) {_NLL}",
    "nll_symmetric": f"""{_MODELS}, two AS (SELECT seq_id, 1 AS strand, seq FROM seqs UNION ALL SELECT seq_id, 2, reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs),
p2 AS (SELECT seq_id, strand, seq, unnest(range(1, length(seq) + 1)) AS i FROM two),
posn AS (SELECT seq_id, strand, substr(seq, greatest(i - 3, 1), i - greatest(i - 3, 1)) AS probe, substr(seq, i, 1) AS symbol FROM p2),
pr AS (SELECT DISTINCT probe FROM posn),{_state('st', 'pr', False)},
sc AS (SELECT posn.seq_id, strand, st.model_id, {_LN} AS s FROM posn JOIN st ON st.probe = posn.probe WHERE symbol <> 'N'),
each AS (SELECT seq_id, model_id, strand, -sum(s) / sum(CASE WHEN s <> 0 THEN 1 ELSE 0 END) AS v FROM sc GROUP BY 1, 2, 3)
SELECT seq_id, model_id, {_r("min(v)", "nll")} FROM each GROUP BY 1, 2""",
    "score_matrix_background": f"""{_MODELS},{_POSITIONS}, pr AS (SELECT DISTINCT probe FROM posn),{_state("st", "pr", False)},
sb AS (SELECT st.*, {", ".join(f"b.p_{x} AS b_{x}" for x in "acgt")} FROM st JOIN models b ON b.model_id = st.model_id AND b.context = CASE WHEN length(st.context) > 1 AND EXISTS (SELECT 1 FROM models e WHERE e.model_id = st.model_id AND e.context = right(st.context, 1)) THEN right(st.context, 1) ELSE '' END),
sc AS (SELECT posn.seq_id, sb.model_id, posn.symbol, CASE symbol WHEN 'A' THEN ln(p_a) - 0.5 * ln(b_a) WHEN 'C' THEN ln(p_c) - 0.5 * ln(b_c) WHEN 'G' THEN ln(p_g) - 0.5 * ln(b_g) WHEN 'T' THEN ln(p_t) - 0.5 * ln(b_t) ELSE 0 END AS s FROM posn JOIN sb ON sb.probe = posn.probe) {_NLL}""",
    "reverse_complement_of": f"WITH {_SEQS} SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM seqs",
    "sliding_windows": f"{_MODELS},{_OWN},{_SCORED} SELECT seq_id, model_id, window_size, pos, {_r('nll', 'nll')} FROM ({_windows((10,))})",
    "sliding_windows_multi": f"{_MODELS},{_OWN},{_SCORED} SELECT seq_id, model_id, window_size, pos, {_r('nll', 'nll')} FROM ({_windows((5, 20))})",
    "sliding_windows_background": f"{_MODELS},{_BG} SELECT seq_id, model_id, window_size, pos, {_r('nll', 'nll')} FROM ({_windows((10,))})",
    "sliding_windows_min_reverse": f"""{_MODELS},{_OWN},{_SCORED}, rp AS (SELECT seq_id, reverse(seq) AS seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs),
rat AS (SELECT seq_id, i - 1 AS pos, substr(seq, greatest(i - 3, 1), i - greatest(i - 3, 1)) AS probe, substr(seq, i, 1) AS symbol FROM rp),
rown AS (SELECT DISTINCT seq_id AS model_id, probe FROM rat),{_state('rst', 'rown', True)},
rsc AS (SELECT rat.seq_id, rst.model_id, rat.pos, {_LN} AS s FROM rat JOIN rst ON rst.model_id = rat.seq_id AND rst.probe = rat.probe),
fw AS ({_windows((10,))}), bw AS ({_windows((10,), "rsc")})
SELECT fw.seq_id, fw.model_id, fw.window_size, fw.pos, {_r("least(fw.nll, bw.nll)", "nll")} FROM fw JOIN seqs ON seqs.seq_id = fw.seq_id
JOIN bw ON bw.seq_id = fw.seq_id AND bw.model_id = fw.model_id AND bw.pos = length(seqs.seq) - 1 - fw.pos""",
    "information_criteria": f"""{_MODELS},{_CHILDREN},{_OWN},{_SCORED},
z AS (SELECT model_id, CAST(3 * sum(CASE WHEN n_children < 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_params, min(count) AS observed_min_count, max(length(context)) AS observed_max_depth FROM kids GROUP BY 1),
l AS (SELECT sc.model_id, sum(CASE WHEN symbol <> 'N' THEN s ELSE 0 END) AS ll, length(any_value(seq)) AS n FROM sc JOIN seqs ON seqs.seq_id = sc.seq_id GROUP BY 1)
SELECT model_id, {_r("ll", "ll")}, n_params, observed_min_count, observed_max_depth, {_r("n_params * ln(n) - 2 * ll", "bic_score")}, {_r("2 * n_params - 2 * ll", "aic_score")},
  {_r("2 * n_params - 2 * ll + CASE WHEN n - n_params - 1 <> 0 THEN (2 * n_params * n_params + 2 * n_params) / CAST(n - n_params - 1 AS DOUBLE) END", "aicc_score")} FROM z JOIN l USING (model_id)""",
    "bic_grid": f"{_GRID} SELECT seq_id, min_count, max_depth, threshold, {', '.join(_r(c, c) for c in ('bic_score', 'aic_score', 'aicc_score', 'log_likelihood'))}, n_params, observed_min_count, observed_max_depth FROM result",
    "best_parameters": f"{_GRID} SELECT seq_id, threshold, {_r('bic_score', 'bic_score')} FROM result QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY round(bic_score, 6), threshold DESC, min_count DESC, max_depth) = 1",
    "d2": f"{_MODELS}, {_RAW}{_pairs(_HALF, _DOT, '1.0')}",
    "dv": f"{_MODELS}, {_RAW}{_pairs(_ANGLE, _DOT, '1.0')}",
    "dvstar": f"{_MODELS}, {_star(0)}{_pairs(_ANGLE, _DOT, '1.0')}",
    "dvstar_bg1": f"{_MODELS}, {_star(1)}{_pairs(_ANGLE, _DOT, '1.0')}",
    "nearest_dvstar": f"{_MODELS}, {_NEAREST}{_pairs(_ANGLE, _NEAREST_SUMS, '1.0')}",
    "penalized_dvstar": f"""{_MODELS}, {_star(0)}, hold AS (SELECT l.model_id AS left_id, r.model_id AS right_id, count(*) AS shared FROM models l JOIN models r ON l.context = r.context GROUP BY 1, 2),
size AS (SELECT model_id, count(*) AS n FROM models GROUP BY 1), base AS (SELECT * FROM (WITH {_pairs(_ANGLE, _DOT, "1.0").lstrip(",").replace(", 6) + 0.0 AS value", ", 15) AS value")}))
SELECT base.left_id, base.right_id, {_r("0.75 * value + 0.25 * (n - shared) / n", "value")} FROM base JOIN hold USING (left_id, right_id) JOIN size ON size.model_id = base.left_id""",
    "d2star": f"{_MODELS}, {_D2STAR}{_pairs(_HALF, _DOT, '1.0')}",
    "cv": f"{_MODELS}, {_CV}{_pairs(_CVDIST, _DOT, '0.0')}",
    "cv_estimation": f"{_MODELS}, {_estimated(3)}{_pairs(_CVDIST, _DOT, '0.0')}",
    "kl": f"{_MODELS}, {_chances(3)}, cw AS (SELECT model_id, word AS context, p FROM chance)" + _pairs("v", _terms("sum(l.p * ln(l.p / r.p) + r.p * ln(r.p / l.p)) / 6 AS v", "cw"), "NULL"),
    "kl_both": f"{_MODELS}, {_ROOTED}, f AS (SELECT model_id, context, count / CAST(root AS DOUBLE) AS p FROM rooted)" + _pairs("CASE WHEN n <> 0 THEN v / 2 / n END", _terms("sum((l.p - r.p) * ln(l.p / r.p)) AS v", "f", ", avg(length(l.context)) AS n"), "NULL"),
    "kl_both_background": f"{_MODELS}, {_ROOTED}, f AS (SELECT model_id, context, {', '.join(f'count / CAST(root AS DOUBLE) * p_{x} / sqrt(r_{x}) AS {x}' for x in 'acgt')} FROM rooted)" + _pairs("v / 2 / n", _terms(f"sum({_KBB}) AS v", "f", ", avg(length(l.context) + 1) AS n"), "NULL"),
    "jensenshannon": f"{_MODELS}, {_ROOTED}, f AS (SELECT model_id, context, {', '.join(f'p_{x} / sqrt(r_{x}) AS {x}' for x in 'acgt')} FROM rooted)" + _pairs("v", _terms(f"sum({_JS}) AS v", "f"), "0.0"),
    "canberra": f"{_MODELS}, {_RAW}" + _pairs("v", _terms(f"sum({' + '.join(f'abs(l.{x} - r.{x}) / (l.{x} + r.{x})' for x in 'acgt')}) AS v", "comp"), "0.0"),
    "correlation": f"{_MODELS}, {_RAW}" + _pairs("CASE WHEN ll - sl * sl / n > 1e-12 AND rr - sr * sr / n > 1e-12 THEN 1 - (lr - sl * sr / n) / (sqrt(ll - sl * sl / n) * sqrt(rr - sr * sr / n)) END", _terms(_SUMS, "comp", ", 4 * count(*) AS n"), "NULL"),
    "shared_contexts": f"{_MODELS} SELECT l.model_id AS left_id, r.model_id AS right_id, l.context FROM models l JOIN models r ON l.context = r.context",
    "context_union": f"""{_MODELS}, size AS (SELECT model_id, count(*) AS n FROM models GROUP BY 1), met AS (SELECT l.model_id AS left_id, r.model_id AS right_id, count(*) AS n_both FROM models l JOIN models r ON l.context = r.context GROUP BY 1, 2)
SELECT left_id, right_id, n_both, a.n - n_both AS n_left, b.n - n_both AS n_right FROM met JOIN size a ON a.model_id = left_id JOIN size b ON b.model_id = right_id""",
    "all_words": f"""WITH {_DOCS},{_document_training(2, 4, 3.9075)}, every AS (SELECT a.x || b.x || c.x AS word FROM {_LETTERS} a, {_LETTERS} b, {_LETTERS} c)
SELECT every.word, CAST(row_number() OVER (ORDER BY every.word) - 1 AS INT) AS place, coalesce(c.n, 0) AS n FROM every LEFT JOIN (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words GROUP BY 1) c ON c.word = every.word""",
    "background_contexts": f"{_MODELS} SELECT model_id, context, right(context, 1) AS background FROM models",
    "composition_vector": f"{_MODELS}, {_CV} {_long('comp')}",
    "scaled_composition_vector": f"{_MODELS}, {_estimated(2)}, sh AS (SELECT n.model_id, n.context, n.count / CAST(r.count AS DOUBLE) AS share FROM named n JOIN models r ON r.model_id = n.model_id AND r.context = ''), "
    + f"sw AS (SELECT comp.model_id, comp.context, a * share AS a, c * share AS c, g * share AS g, t * share AS t FROM comp JOIN sh ON sh.model_id = comp.model_id AND sh.context = comp.context) {_long('sw')}",
    "adjusted_transition_vector": f"{_MODELS}, {_star(1).replace(' WHERE length(m.context) > 1', '')} {_long('comp')}",
    "word_frequency_vector": f"{_MODELS}, {_chances(2)} SELECT c.model_id, word, {_r('(m.count - 1) * p', 'component')} FROM chance c JOIN models m ON m.model_id = c.model_id AND m.context = ''",
    "adjusted_word_frequency_vector": f"""{_MODELS}, {_chances(2)}, flat AS (SELECT * FROM models WHERE context = ''), {_chances(2, "flat", "b_")}
SELECT c.model_id, c.word, {_r("(m.count - 1) * c.p / sqrt((m.count - 1) * b.p)", "component")} FROM chance c JOIN b_chance b ON b.model_id = c.model_id AND b.word = c.word JOIN models m ON m.model_id = c.model_id AND m.context = ''""",
    "search_pattern": f"""WITH {_SEQS}, pt AS (SELECT unnest(['A', 'AT', 'TTA', 'NT', 'ACGTACGT', '']) AS pattern), posn AS (SELECT seq_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM seqs)
SELECT seq_id, pattern, pos FROM posn, pt WHERE pos + length(pattern) <= length(seq) AND substr(seq, pos + 1, length(pattern)) = pattern""",
    "substring_labels": f"""WITH {_SEQS}, st AS (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs), sb AS (SELECT seq_id, seq, i, unnest(range(1, least(100, length(seq) - i + 1) + 1)) AS k FROM st),
lb AS (SELECT seq_id, substr(seq, i, k) AS label, count(*) AS n, count(DISTINCT substr(seq, i + k, 1)) AS f, bool_or(i + k > length(seq)) AS e FROM sb GROUP BY 1, 2)
SELECT seq_id, label, n FROM lb WHERE f > 1 OR (n = 1 AND e) UNION ALL SELECT seq_id, '', 1 FROM seqs""",
    "tree_height": f"""WITH {_SEQS}, st AS (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs), sb AS (SELECT seq_id, seq, i, unnest(range(1, least(100, length(seq) - i + 1) + 1)) AS k FROM st),
lb AS (SELECT seq_id, substr(seq, i, k) AS label, count(*) AS n, count(DISTINCT substr(seq, i + k, 1)) AS f FROM sb GROUP BY 1, 2)
SELECT seq_id, max(length(label)) AS height FROM lb WHERE n > 1 AND f > 1 GROUP BY 1""",
    "jensenshannon_compat": f"{_MODELS}, {_ROOTED}, f AS (SELECT model_id, context, {', '.join(f'p_{x} / sqrt(r_{x}) AS {x}' for x in 'acgt')} FROM rooted)" + _pairs("v", _terms(f"sum({' + '.join(f'0.5 * l.{x} * ln(l.{x} / r.{x})' for x in 'acgt')}) AS v", "f"), "0.0"),
    "correlation_compat": f"{_MODELS}, {_RAW}" + _pairs("CASE WHEN ll - sl * sl / n > 1e-12 AND rr - sr * sr / n > 1e-12 THEN 1 - (lr - sl * sr / n) / (ll - sl * sl / n) END", _terms(_SUMS, "comp", ", 4 * count(*) AS n"), "NULL"),
    "d2_two_sets": f"""{_MODELS}, {_FEWER}, dots AS (SELECT l.model_id AS left_id, r.model_id AS right_id, sum({_dot("l", "r")}) AS lr, sum({_dot("l", "l")}) AS ll, sum({_dot("r", "r")}) AS rr FROM models l JOIN fewer r ON l.context = r.context GROUP BY 1, 2)
SELECT left_id, right_id, {_r("0.5 * (1 - lr / (sqrt(ll) * sqrt(rr)))", "value")} FROM dots""",
    "kl_both_two_sets": f"""{_MODELS}, {_FEWER}, lf AS (SELECT m.model_id, m.context, m.count / CAST(t.count AS DOUBLE) AS p FROM models m JOIN models t ON t.model_id = m.model_id AND t.context = ''),
rf AS (SELECT m.model_id, m.context, m.count / CAST(t.count AS DOUBLE) AS p FROM fewer m JOIN fewer t ON t.model_id = m.model_id AND t.context = ''),
sums AS (SELECT l.model_id AS left_id, r.model_id AS right_id, sum((l.p - r.p) * ln(l.p / r.p)) AS v, avg(length(l.context)) AS n FROM lf l JOIN rf r ON l.context = r.context GROUP BY 1, 2)
SELECT left_id, right_id, {_r("CASE WHEN n > 0 THEN v / 2 / n END", "value")} FROM sums""",
    "fasta_models": f"{_MODELS} SELECT model_id || ' a->b' AS model_id, context, count, {_PS} FROM models",
    "fastq_models": f"{_MODELS} SELECT model_id || ' a->b' AS model_id, context, count, {_PS} FROM models",
    "jaccard_given_words": f"""{_MODELS}, {_WORD_SCORES}, sums AS (SELECT l.model_id AS left_id, r.model_id AS right_id, sum(CASE WHEN l.f >= 1 AND r.f >= 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN l.f >= 1 OR r.f >= 1 THEN 1 ELSE 0 END) AS e FROM scored l JOIN scored r ON l.word = r.word GROUP BY 1, 2)
SELECT left_id, right_id, {_r("10 * (1 - pow(2 * (b / e) / (b / e + 1), 0.25))", "value")} FROM (SELECT left_id, right_id, CAST(b AS DOUBLE) AS b, nullif(CAST(e AS DOUBLE), 0) AS e FROM sums)""",
    "jaccard_prob_given_words": f"""{_MODELS}, {_WORD_SCORES}, sums AS (SELECT l.model_id AS left_id, r.model_id AS right_id, avg(abs(l.l - r.l)) AS gap, avg((l.f + r.f) / 2) AS mean FROM scored l JOIN scored r ON l.word = r.word GROUP BY 1, 2)
SELECT left_id, right_id, {_r("gap * ln(mean)", "value")} FROM sums""",
    "nll_distance_given_samples": f"""{_MODELS},{_POSITIONS}, pr AS (SELECT DISTINCT probe FROM posn),{_state("st", "pr", False)},
sc AS (SELECT posn.seq_id, st.model_id, {_LN} AS s FROM posn JOIN st ON st.probe = posn.probe WHERE symbol <> 'N'),
v AS (SELECT seq_id, model_id, -sum(s) / sum(CASE WHEN s <> 0 THEN 1 ELSE 0 END) AS v FROM sc GROUP BY 1, 2)
SELECT a.seq_id AS left_id, a.model_id AS right_id, {_r("(a.v + b.v) / 2", "value")} FROM v a JOIN v b ON a.seq_id = b.model_id AND a.model_id = b.seq_id""",
}

ORACLE_SQL["nll_symmetric_own"] = f"SELECT * FROM ({ORACLE_SQL['nll_symmetric']}) WHERE seq_id = model_id"
ORACLE_SQL["penalized_dvstar_symmetric"] = ORACLE_SQL["penalized_dvstar"].replace("(n - shared) / n", "(size.n + o.n - 2 * shared) / (size.n + o.n - shared)") + " JOIN size o ON o.model_id = base.right_id"
ORACLE_SQL["score_matrix_automaton"] = ORACLE_SQL["score_matrix"]
ORACLE_SQL["search_index"] = ORACLE_SQL["search_pattern"]
ORACLE_SQL["suffix_tree_nodes"] = ORACLE_SQL["substring_labels"].replace(" UNION ALL SELECT seq_id, '', 1 FROM seqs", "")
ORACLE_SQL["suffix_links"] = f"""WITH nodes AS ({ORACLE_SQL["suffix_tree_nodes"]})
SELECT a.seq_id, a.label, a.n, CASE WHEN length(a.label) = 1 THEN '' ELSE b.label END AS link FROM nodes a LEFT JOIN nodes b ON b.seq_id = a.seq_id AND b.label = substr(a.label, 2) AND length(a.label) > 1"""
ORACLE_SQL["suffix_array"] = f"""WITH {_SEQS}, st AS (SELECT seq_id, i - 1 AS pos, substr(seq, i) AS s FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs)),
o AS (SELECT seq_id, pos, s, row_number() OVER w - 1 AS place, lag(s) OVER w AS p FROM st WINDOW w AS (PARTITION BY seq_id ORDER BY s))
SELECT seq_id, place, pos, CASE WHEN p IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(s), length(p)) + 1), lambda k: left(s, CAST(k AS INT)) = left(p, CAST(k AS INT)))) END AS lcp FROM o"""
ORACLE_SQL["nll_background_distance_given_samples"] = f"""WITH v AS ({ORACLE_SQL["score_matrix_background"].replace(", 6) + 0.0 AS nll", ", 15) AS nll")})
SELECT a.seq_id AS left_id, a.model_id AS right_id, {_r("(a.nll + b.nll) / 2", "value")} FROM v a JOIN v b ON a.seq_id = b.model_id AND a.model_id = b.seq_id"""
_BEST = " UNION ALL ".join(
    f"SELECT model_id AS seq_id, '{c}' AS criterion, min_count, max_depth, threshold, {_r(c, 'value')} FROM result WHERE {c} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY round({c}, 6), threshold DESC, min_count DESC, max_depth) = 1"
    for c in ("bic_score", "aic_score", "aicc_score")
)
ORACLE_SQL["bic_grid_default"] = f"""WITH {_SEQS},{_training(3, 2, 0.0)},
cuts AS (SELECT i, CAST(round(1.3 + 0.1 * (i - 1), 10) AS DOUBLE) AS threshold FROM (SELECT unnest(range(1, 501)) AS i)),
settings AS (SELECT * FROM (SELECT unnest([2, 3, 4, 5, 6, 7, 8, 9, 10, 20])::INT AS min_count), (SELECT unnest([1, 2, 3])::INT AS max_depth)),
seen AS (SELECT model_id, left(word, length(word) - 1) AS context, {", ".join(f"sum(CASE WHEN right(word, 1) = '{x.upper()}' THEN n ELSE 0 END) AS n_{x}" for x in "acgt")} FROM words GROUP BY 1, 2),
gain AS (
  SELECT c.model_id, c.context, c.count, length(c.context) AS depth, {" + ".join(f"coalesce(n_{x}, 0) * (ln(c.p_{x}) - coalesce(ln(p.p_{x}), 0))" for x in "acgt")} AS gain
  FROM probs c LEFT JOIN probs p ON p.model_id = c.model_id AND c.context <> '' AND p.context = substr(c.context, 2) LEFT JOIN seen ON seen.model_id = c.model_id AND seen.context = c.context),
gd AS (SELECT model_id, min_count, max_depth, delta, unnest(list_transform(range(1, length(context) + 1), lambda k: right(context, CAST(k AS INT)))) AS context FROM delta, settings WHERE count >= min_count AND length(context) <= max_depth),
gs AS (SELECT model_id, min_count, max_depth, context, max(delta) AS most FROM gd GROUP BY ALL),
held AS (
  SELECT gs.model_id, gs.min_count, gs.max_depth, gs.context, gain, count, depth, (SELECT count(*) FROM cuts WHERE threshold <= most) AS last FROM gs JOIN gain ON gain.model_id = gs.model_id AND gain.context = gs.context
  UNION ALL SELECT model_id, min_count, max_depth, context, gain, count, depth, 500 FROM gain, settings WHERE context = ''),
kept AS (SELECT model_id, min_count, max_depth, last, sum(gain) AS ll, count(*) AS terminal FROM held GROUP BY ALL),
inner_ AS (
  SELECT model_id, min_count, max_depth, last, count(*) AS inner_ FROM (SELECT model_id, min_count, max_depth, substr(context, 2) AS above, list_sort(list(last), 'DESC')[4] AS last FROM held WHERE context <> '' GROUP BY ALL) WHERE last > 0 GROUP BY ALL),
dense AS (
  SELECT s.model_id, s.min_count, s.max_depth, cuts.threshold, s.length, sum(coalesce(kept.ll, 0)) OVER w AS ll, 3 * (sum(coalesce(terminal, 0)) OVER w - sum(coalesce(inner_, 0)) OVER w) AS k
  FROM (SELECT seq_id AS model_id, length(seq) AS length, min_count, max_depth FROM seqs, settings) s CROSS JOIN cuts
  LEFT JOIN kept ON kept.model_id = s.model_id AND kept.min_count = s.min_count AND kept.max_depth = s.max_depth AND kept.last = cuts.i
  LEFT JOIN inner_ ON inner_.model_id = s.model_id AND inner_.min_count = s.min_count AND inner_.max_depth = s.max_depth AND inner_.last = cuts.i
  WINDOW w AS (PARTITION BY s.model_id, s.min_count, s.max_depth ORDER BY cuts.i DESC ROWS UNBOUNDED PRECEDING)),
result AS (SELECT *, k * ln(length) - 2 * ll AS bic_score, 2 * k - 2 * ll AS aic_score, 2 * k - 2 * ll + (2 * k * k + 2 * k) / nullif(CAST(length - k - 1 AS DOUBLE), 0) AS aicc_score FROM dense)
{_BEST}"""
ORACLE_SQL["tree_files"] = ORACLE_SQL["tree_text_round_trip"]
ORACLE_SQL["tree_text_with_pseudo"] = f"""{_MODELS} SELECT model_id, context, {", ".join(f"CAST(round(p_{x} * (count + 4) - 1) + 1 AS BIGINT) AS n_{x}" for x in "acgt")} FROM models"""
ORACLE_SQL["models_by_id"] = ORACLE_SQL["cutoff_prune"] + " WHERE model_id IN ('1', '2', '30')"
ORACLE_SQL["windows_stored"] = ORACLE_SQL["sliding_windows"]
ORACLE_SQL["vectors_stored"] = ORACLE_SQL["composition_vector"]
ORACLE_SQL["scores_stored"] = ORACLE_SQL["nll"]
ORACLE_SQL["distances_stored"] = f"SELECT *, 'dvstar-0' AS name FROM ({ORACLE_SQL['dvstar']})"
ORACLE_SQL["criteria_log"] = f"SELECT * EXCLUDE (seq_id) FROM ({ORACLE_SQL['bic_grid']})"
ORACLE_SQL["listed_files"] = f"WITH {_SEQS} SELECT seq_id, seq FROM seqs"
ORACLE_SQL["file_model"] = f"""WITH {_SEQS.replace("seqs AS", "each AS")}, seqs AS (SELECT string_agg(seq_id, '|' ORDER BY seq_id) AS seq_id, string_agg(seq, 'N' ORDER BY seq_id) AS seq FROM each),{_training(3, 2, 0.5)}
SELECT model_id, context, count, {_PS} FROM models"""
ORACLE_SQL["search_sql"] = ORACLE_SQL["search_pattern"]
ORACLE_SQL["subtree_sql"] = ORACLE_SQL["pst_subtree"]
_ROOT_OF = "CASE symbol WHEN 'A' THEN sqrt(p_a) WHEN 'C' THEN sqrt(p_c) WHEN 'G' THEN sqrt(p_g) WHEN 'T' THEN sqrt(p_t) ELSE 0 END"
ORACLE_SQL["foreign_score"] = ORACLE_SQL["nll"].replace(_LN, _ROOT_OF)
_KL_SQL = " + ".join(f"c.p_{x} * ln(c.p_{x} / p.p_{x})" for x in "acgt")
ORACLE_SQL["foreign_estimator"] = ORACLE_SQL["cutoff_prune"].replace(_KL_SQL, " + ".join(f"(c.p_{x} - p.p_{x}) * (c.p_{x} - p.p_{x}) / p.p_{x}" for x in "acgt"))
assert ORACLE_SQL["foreign_score"] != ORACLE_SQL["nll"] and ORACLE_SQL["foreign_estimator"] != ORACLE_SQL["cutoff_prune"]
ORACLE_SQL["block_files"] = f"""WITH {_DOCS} SELECT seq_id, length(seq) AS length, {", ".join(f"length(seq) - length(replace(seq, '{x}', '')) AS n_{x.lower()}" for x in "ACGTN")} FROM seqs"""
