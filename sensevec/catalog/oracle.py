"""The catalogue queries in SQL, written from the formulas and not from the Spark plans."""

from __future__ import annotations

import re

from ..functions.mixer import FACTOR_1, FACTOR_2, FACTOR_I, FACTOR_SEED, PRIME, ROUND_CONSTANTS
from ..operators.context import BATCH
from ..plans.train import TrainParams
from .fixture import (
    ALPHA,
    COUNT_SEED,
    COUNT_SHARE,
    DIM,
    DISCOUNT,
    IN_SEED,
    MIN_FREQ,
    OUT_SEED,
    SCALE,
    SENSES,
    WINDOW,
)
from .queries import CAP, KEEP, LR, THRESHOLD, TRAINING, WSI_WINDOW

WHITE = r"[ \t\n\x0B\f\r]+"
KS = range(1, SENSES + 1)


def simple(col: str) -> str:
    ascii_only = rf"regexp_replace({col}, '[^\x00-\x7F]', '', 'g')"
    spaced = rf"regexp_replace(lower({ascii_only}), '[!-/:-@\[-`{{-~ \t\n\x0B\f\r]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({spaced}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def mixed(id1: str, id2: str, i: str, seed: int) -> str:
    a = (
        f"(({id1})::BIGINT % {PRIME} * {FACTOR_1} + ({id2})::BIGINT % {PRIME} * {FACTOR_2} "
        f"+ ({i})::BIGINT % {PRIME} * {FACTOR_I} + {seed % PRIME * FACTOR_SEED % PRIME}) % {PRIME}"
    )
    for n, c in enumerate(ROUND_CONSTANTS):
        a = f"list_transform([{a}], lambda m{n}: (m{n} * m{n} + {c}) % {PRIME})[1]"
    return f"({a})"


def uniform(id1: str, id2: str, i: str, seed: int) -> str:
    return f"({mixed(id1, id2, i, seed)} / {float(PRIME)})"


def digamma(x: str) -> str:
    y = f"(({x}) + 6)"
    tail = (
        f"- 1.0/(12*{y}*{y}) + 1.0/(120*pow({y}, 4)) - 1.0/(252*pow({y}, 6)) + 1.0/(240*pow({y}, 8)) - 1.0/(132*pow({y}, 10))"
    )
    shift = " ".join(f"- 1.0/(({x}) + {i})" for i in range(6))
    return f"(ln({y}) - 0.5/{y} {tail} {shift})"


def log_sigmoid(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN {x} - ln(1 + exp({x})) ELSE -ln(1 + exp(-({x}))) END)"


def tokenised(source: str, doc_id: str, text: str) -> str:
    return f"""
        SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (
            SELECT {doc_id} AS doc_id, list_filter(string_split({simple(text)}, ' '), lambda w: w <> '') AS ws FROM {source})"""


def pairs_within(window: int) -> str:
    """Neighbours by distance, ``o`` being the signed distance."""
    offsets = [o for o in range(-window, window + 1) if o]
    near = ", ".join(f"{'lag' if o < 0 else 'lead'}(word_id, {abs(o)}) OVER w" for o in offsets)
    return f"""
        SELECT doc_id, chunk_id, pos, x, y, o FROM (
            SELECT doc_id, chunk_id, pos, word_id AS x, unnest([{near}]) AS y, unnest({offsets}) AS o
            FROM tokens WINDOW w AS (PARTITION BY doc_id, chunk_id ORDER BY pos)) WHERE y IS NOT NULL"""


def pairs_joined(window: int) -> str:
    """The same pairs from equal positions of a self join."""
    offsets = ", ".join(f"({o})" for o in range(-window, window + 1) if o)
    return f"""
        SELECT a.doc_id, a.chunk_id, a.pos, a.word_id AS x, b.word_id AS y
        FROM (SELECT *, pos + o AS at FROM tokens CROSS JOIN (VALUES {offsets}) o(o)) a
        JOIN tokens b ON b.doc_id = a.doc_id AND b.chunk_id = a.chunk_id AND b.pos = a.at"""


def random_vec(key: str, slot: str, seed: int, scale: float) -> str:
    cell = f"(({uniform(key, slot, 'i', seed)} - 0.5) * {scale})::FLOAT::DOUBLE"
    return f"list_transform(range(0, {DIM}), lambda i: {cell})"


_share = [f"freq * {uniform('word_id', str(k), '0', COUNT_SEED)} * {s}" for k, s in zip(KS, COUNT_SHARE)]
_share[2] = f"CASE WHEN word_id % 3 = 0 THEN 0.0 ELSE {_share[2]} END"


def _sticks(alpha: float = ALPHA, d: float = DISCOUNT) -> str:
    """Stick-breaking priors, written out sense by sense."""
    head = f"""
        SELECT word_id, freq, c1, c2, c3,
            1 + c1 - {d} AS a1, {alpha} + {d} + c2 + c3 AS b1,
            1 + c2 - {d} AS a2, {alpha} + 2*{d} + c3 AS b2 FROM sense_counts"""
    return f"""
        SELECT word_id, freq, a1/(a1+b1) AS p1, a2/(a2+b2) * (1 - a1/(a1+b1)) AS p2,
            greatest(1 - a1/(a1+b1) - a2/(a2+b2) * (1 - a1/(a1+b1)), 0) AS p3,
            {digamma('a1')} - {digamma('a1+b1')} AS l1,
            {digamma('a2')} - {digamma('a2+b2')} + {digamma('b1')} - {digamma('a1+b1')} AS l2,
            {digamma('b1')} - {digamma('a1+b1')} + {digamma('b2')} - {digamma('a2+b2')} AS l3
        FROM ({head})"""


def _posterior(start: list[str]) -> str:
    """``(doc_id, chunk_id, pos, x, z1, z2, z3)`` from a start score per sense."""
    raw = ", ".join(f"({s}) + coalesce(ll{k}, 0) AS s{k}" for k, s in zip(KS, start))
    e = [f"exp(s{k} - greatest(s1, s2, s3))" for k in KS]
    z = ", ".join(f"{e[k - 1]} / ({' + '.join(e)}) AS z{k}" for k in KS)
    return f"""
        SELECT doc_id, chunk_id, pos, x, {z} FROM (
            SELECT t.doc_id, t.chunk_id, t.pos, t.word_id AS x, {raw}
            FROM tokens t JOIN prior p ON p.word_id = t.word_id
            LEFT JOIN context_ll c ON c.doc_id = t.doc_id AND c.chunk_id = t.chunk_id AND c.pos = t.pos)"""


def log_pi(k: int, min_prob: float = 1e-3) -> str:
    return f"CASE WHEN p.p{k} < {min_prob} THEN '-inf'::DOUBLE ELSE ln(p.p{k}) END"


def _value(min_prob: float) -> str:
    terms = [f"CASE WHEN p{k} < {min_prob} THEN 0 ELSE p{k} * exp(ll{k}) END" for k in KS]
    return f"SELECT x, y, ln({' + '.join(terms)}) AS v FROM pair_ll JOIN prior ON word_id = x"


_instance_words = f"""
        SELECT doc_id, ws, (len(ws) + 1) // 2 AS m, lang FROM (
            SELECT doc_id, lang, string_split({simple('text')}, ' ') AS ws FROM documents) WHERE ws[1] <> ''"""

# a binary tree by repeated merging of the two lightest items: words before nodes, older nodes first
_merges = """
        SELECT 0::BIGINT AS node, 0::BIGINT AS li, 0::BIGINT AS ni, []::BIGINT[] AS q,
            false AS l1, 0::BIGINT AS i1, false AS l0, 0::BIGINT AS i0
        UNION ALL
        SELECT node + 1, li + (CASE WHEN second THEN 1 ELSE 0 END), ni + (CASE WHEN second THEN 0 ELSE 1 END),
            list_append(q, weight + CASE WHEN second THEN l[li + 1] ELSE q[ni + 1] END),
            first, CASE WHEN first THEN li - 1 ELSE ni - 1 END,
            second, CASE WHEN second THEN li ELSE ni END
        FROM (SELECT *, ni >= len(q) OR (li < v AND l[li + 1] <= q[ni + 1]) AS second FROM (
            SELECT node, q, l, v, first, CASE WHEN first THEN l[li + 1] ELSE q[ni + 1] END AS weight,
                li + (CASE WHEN first THEN 1 ELSE 0 END) AS li, ni + (CASE WHEN first THEN 0 ELSE 1 END) AS ni FROM (
                SELECT merges.*, l, v, ni >= len(q) OR (li < v AND l[li + 1] <= q[ni + 1]) AS first
                FROM merges, leaf_list WHERE node < v - 1)))"""

# name -> (needed relations, query)
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "words": ((), tokenised("documents", "doc_id", "text")),
    "raw_words": (
        (),
        f"""
        SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (
            SELECT doc_id, list_filter(string_split_regex(text, '{WHITE}'), lambda w: w <> '') AS ws FROM documents)""",
    ),
    "turn_words": ((), tokenised("conversations", "conv_id * 1000 + turn", "text")),
    "counts": (("words",), "SELECT word, count(*) AS freq FROM words GROUP BY word"),
    "stop_words": (
        (),
        f"SELECT word FROM ({tokenised('benchmark', 'item_id', 'text')}) GROUP BY word HAVING count(*) >= 10",
    ),
    "vocab": (
        ("counts",),
        f"""SELECT row_number() OVER (ORDER BY freq DESC, word) AS word_id, word, freq
        FROM counts WHERE freq >= {MIN_FREQ}""",
    ),
    "tokens": (
        ("words", "vocab"),
        f"""SELECT doc_id, (pos - 1) // {BATCH} AS chunk_id, word_id, freq,
            row_number() OVER (PARTITION BY doc_id, (pos - 1) // {BATCH} ORDER BY pos) AS pos
        FROM words JOIN vocab USING (word)""",
    ),
    "pairs": (("tokens",), pairs_within(WINDOW)),
    "pair_counts": (("pairs",), "SELECT x, y, count(*) AS n FROM pairs GROUP BY x, y"),
    "leaf": (("vocab",), "SELECT word_id, row_number() OVER (ORDER BY freq, word) - 1 AS idx, freq FROM vocab"),
    "leaf_list": (("leaf",), "SELECT list(freq ORDER BY idx) AS l, count(*) AS v FROM leaf"),
    "merges": (("leaf_list",), _merges),
    "links": (
        ("merges",),
        """SELECT l1 AS is_leaf, i1 AS idx, node, 1 AS code FROM merges WHERE node > 0
        UNION ALL SELECT l0, i0, node, 0 FROM merges WHERE node > 0""",
    ),
    "climb": (
        ("links", "leaf"),
        """SELECT f.word_id, 1 AS depth, k.node AS node_id, k.code FROM leaf f JOIN links k ON k.is_leaf AND k.idx = f.idx
        UNION ALL
        SELECT t.word_id, t.depth + 1, k.node, k.code FROM climb t JOIN links k ON NOT k.is_leaf AND k.idx = t.node_id - 1""",
    ),
    "tree": (("climb",), "SELECT word_id, depth, node_id, code FROM climb"),
    "in_vec": (
        ("vocab",),
        f"""SELECT word_id, sense, {random_vec('word_id', 'sense', IN_SEED, SCALE)} AS vec
        FROM vocab, range(1, {SENSES + 1}) s(sense)""",
    ),
    "out_vec": (
        ("vocab",),
        f"""SELECT node_id, {random_vec('node_id', '0', OUT_SEED, SCALE)} AS vec
        FROM (SELECT word_id - 1 AS node_id FROM vocab WHERE word_id > 1)""",
    ),
    "sense_counts": (
        ("vocab",),
        f"SELECT word_id, freq, {', '.join(f'({s})::DOUBLE AS c{k}' for k, s in zip(KS, _share))} FROM vocab",
    ),
    "prior": (("sense_counts",), _sticks()),
    "node_f": (
        ("pair_counts", "tree", "in_vec", "out_vec"),
        """SELECT x, n.node_id, sense, list_dot_product(v.vec, o.vec) AS f
        FROM (SELECT DISTINCT x, node_id FROM pair_counts JOIN tree ON tree.word_id = y) n
        JOIN in_vec v ON v.word_id = x JOIN out_vec o ON o.node_id = n.node_id""",
    ),
    "node_wide": (
        ("node_f",),
        f"""SELECT x, node_id, {', '.join(f'max(f) FILTER (sense = {k}) AS f{k}' for k in KS)}
        FROM node_f GROUP BY x, node_id""",
    ),
    "pair_steps": (
        ("pair_counts", "tree"),
        "SELECT x, y, n, node_id, code FROM pair_counts JOIN tree ON tree.word_id = y",
    ),
    "pair_ll": (
        ("pair_steps", "node_wide"),
        f"""SELECT x, y, any_value(n) AS n, {', '.join(f"sum({log_sigmoid(f'(f{k} * (1 - 2*code))')}) AS ll{k}" for k in KS)}
        FROM pair_steps JOIN node_wide USING (x, node_id) GROUP BY x, y""",
    ),
    "context_ll": (
        ("pairs", "pair_ll"),
        f"""SELECT doc_id, chunk_id, pos, {', '.join(f'sum(ll{k}) AS ll{k}' for k in KS)}
        FROM pairs JOIN pair_ll USING (x, y) GROUP BY doc_id, chunk_id, pos""",
    ),
    "train_z": (("tokens", "prior", "context_ll"), _posterior([f"p.l{k}" for k in KS])),
    "query_z": (("tokens", "prior", "context_ll"), _posterior([log_pi(k) for k in KS])),
    "plain_z": (("tokens", "prior", "context_ll"), _posterior(["0.0"] * SENSES)),
    "inst": (
        (),
        f"""SELECT doc_id, lang, ws, m, ws[m] AS word, ws[m] || '.n' AS key, doc_id::INT AS instance FROM ({_instance_words})""",
    ),
    "inst_words": (
        ("inst",),
        """SELECT key, instance, side, word, i FROM (
            SELECT key, instance, CASE WHEN p < m THEN 'left' ELSE 'right' END AS side, ws[p] AS word, abs(p - m) AS i
            FROM (SELECT key, instance, ws, m, unnest(range(1, len(ws) + 1)) AS p FROM inst) WHERE p <> m)""",
    ),
    "inst_context": (
        ("inst_words", "vocab"),
        f"""SELECT key, instance, side, r, word_id FROM (
            SELECT key, instance, side, word_id, row_number() OVER (PARTITION BY key, instance, side ORDER BY i) AS r
            FROM inst_words JOIN vocab USING (word)) WHERE r <= {WSI_WINDOW}""",
    ),
    "nested_context": (
        ("inst", "vocab", "stop_words"),
        f"""SELECT word, sense, context_id, side, r, word_id FROM (
            SELECT n.word, sense, context_id, side, word_id,
                row_number() OVER (PARTITION BY n.word, sense, context_id, side ORDER BY i) AS r
            FROM (SELECT word, sense, context_id, near, CASE WHEN p <= m THEN 'left' ELSE 'right' END AS side, abs(p - m) AS i
                FROM (SELECT word, lang AS sense, doc_id AS context_id, m, unnest(ws) AS near,
                    unnest(range(1, len(ws) + 1)) AS p FROM inst WHERE word IN (SELECT word FROM vocab))) n
            JOIN vocab ON vocab.word = near WHERE near NOT IN (SELECT word FROM stop_words)) WHERE r <= {WSI_WINDOW}""",
    ),
    "line_labels": (
        (),
        """SELECT 'k' || l_linenumber AS key, l_orderkey::INT AS instance, l_returnflag AS truth, l_linestatus AS pred,
            year(l_shipdate) AS dataset FROM lineitem""",
    ),
    "vectors": ((), "SELECT vec_id AS word_id, embedding::DOUBLE[] AS vec FROM embeddings"),
    "norms": (("vectors",), "SELECT word_id, vec, sqrt(list_dot_product(vec, vec)) AS len FROM vectors"),
}

RECURSIVE = ("merges", "climb")


def scored_contexts(name: str, keys: str, context: str, target: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Relations that pick a sense for contexts ``(keys, word_id)`` of targets ``(keys, x)``."""
    f = "list_dot_product(v.vec, o.vec)"
    ll = f"""
        SELECT x, y, {', '.join(f"sum({log_sigmoid('t')}) FILTER (sense = {k}) AS ll{k}" for k in KS)} FROM (
            SELECT x, y, sense, {f} * (1 - 2*code) AS t
            FROM (SELECT DISTINCT x, word_id AS y FROM {context} JOIN {target} USING ({keys})) d
            JOIN tree ON tree.word_id = y JOIN in_vec v ON v.word_id = x JOIN out_vec o ON o.node_id = tree.node_id)
        GROUP BY x, y"""
    raw = ", ".join(f"any_value({log_pi(k)}) + coalesce(sum(ll{k}), 0) AS s{k}" for k in KS)
    sums = f"""
        SELECT {keys}, {raw} FROM {target} t LEFT JOIN {context} c USING ({keys})
        LEFT JOIN {name}_ll l ON l.x = t.x AND l.y = c.word_id JOIN prior p ON p.word_id = t.x GROUP BY {keys}"""
    best = f"""
        SELECT {keys}, s1, s2, s3, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS sense FROM {name}_s"""
    base = ("tree", "in_vec", "out_vec", "prior", context, target)
    return {f"{name}_ll": (base, ll), f"{name}_s": ((f"{name}_ll", *base), sums), f"{name}_best": ((f"{name}_s",), best)}


RELATIONS["inst_target"] = (("inst", "vocab"), "SELECT key, instance, word_id AS x FROM inst JOIN vocab USING (word)")
RELATIONS |= scored_contexts("inst", "key, instance", "inst_context", "inst_target")
RELATIONS["nested_target"] = (
    ("inst", "vocab", "prior"),
    """SELECT word, lang AS sense, doc_id AS context_id, word_id AS x
        FROM inst JOIN vocab USING (word) JOIN prior USING (word_id)
        WHERE vocab.freq >= 500 AND (p1 >= 0.001)::INT + (p2 >= 0.001)::INT + (p3 >= 0.001)::INT > 1""",
)
RELATIONS |= scored_contexts("nested", "word, sense, context_id", "nested_context", "nested_target")
RELATIONS["nested_cells"] = (
    ("nested_best",),
    "SELECT word, sense AS truth, pred, count(*) AS n FROM (SELECT word, sense, "
    "CASE WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS pred FROM nested_s) GROUP BY ALL",
)
RELATIONS["nested_cells"] = (("nested_s",), RELATIONS["nested_cells"][1])

RELATIONS["nested_numbers"] = (
    ("inst", "vocab"),
    """SELECT doc_id, word, freq AS weight, lang, rec, accent, m, ws,
        dense_rank() OVER (PARTITION BY word, rec ORDER BY lang, accent) AS sense_no,
        row_number() OVER (PARTITION BY word, rec, lang, accent ORDER BY doc_id) AS context_id
    FROM (SELECT *, doc_id % 2 AS rec, (doc_id // 2) % 2 AS accent FROM inst JOIN vocab USING (word))""",
)
RELATIONS["ordered_tokens"] = (
    ("tokens",),
    """SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id, pos) - 1 AS place,
        row_number() OVER (PARTITION BY word_id ORDER BY doc_id DESC, chunk_id DESC, pos DESC) - 1 AS behind FROM tokens""",
)

RELATIONS["requests"] = (
    ("inst", "vocab"),
    f"""SELECT doc_id, side, p, v.word_id FROM (
        SELECT doc_id, m, 'c' AS side, ws, unnest(range(greatest(m - {WSI_WINDOW}, 1), least(m + {WSI_WINDOW}, len(ws)) + 1)) AS p
        FROM inst) r JOIN vocab v ON v.word = ws[p] WHERE p <> m""",
)
RELATIONS["request_target"] = (("inst", "vocab"), "SELECT doc_id, word_id AS x FROM inst JOIN vocab USING (word)")
RELATIONS |= scored_contexts("request", "doc_id", "requests", "request_target")


def cells_totals(cells: str, *keys: str) -> str:
    """Pair sums and entropies of a contingency table, per key."""
    ks = ", ".join(keys)
    by = f"{ks}, " if keys else ""
    group = f"GROUP BY {ks}" if keys else ""
    using = f"USING ({ks})" if keys else "ON true"

    def part(name: str, inner: str) -> str:
        return (
            f"(SELECT {by}sum(n*(n-1)/2.0) AS {name}2, sum(n*ln(n)) AS {name}l, count(*) AS {name}c, sum(n) AS {name}n "
            f"FROM ({inner}) {group}) q_{name}"
        )

    cell = part("c", f"SELECT {by}truth, pred, sum(n) AS n FROM {cells} GROUP BY {by}truth, pred")
    row = part("a", f"SELECT {by}truth, sum(n) AS n FROM {cells} GROUP BY {by}truth")
    col = part("b", f"SELECT {by}pred, sum(n) AS n FROM {cells} GROUP BY {by}pred")
    return f"SELECT * FROM {cell} JOIN {row} {using} JOIN {col} {using}"


ARI = "(c2 - a2*b2/nullif(cn*(cn-1)/2.0, 0)) / nullif((a2+b2)/2 - a2*b2/nullif(cn*(cn-1)/2.0, 0), 0)"
ARI_EQUAL = f"CASE WHEN ac > 1 THEN CASE WHEN c2 = a2 AND c2 = b2 THEN 1.0 ELSE {ARI} END END"
_ha, _hb, _hc = "(ln(cn) - al/cn)", "(ln(cn) - bl/cn)", "(ln(cn) - cl/cn)"
_mi = f"greatest({_ha} + {_hb} - {_hc}, 0)"
_h = f"(CASE WHEN ac = 1 THEN 1.0 ELSE {_mi}/{_ha} END)"
_c = f"(CASE WHEN bc = 1 THEN 1.0 ELSE {_mi}/{_hb} END)"
V_MEASURE = f"coalesce(2*{_h}*{_c}/nullif({_h}+{_c}, 0), 0)"
F_SCORE = "2*(c2/nullif(b2,0))*(c2/nullif(a2,0))/nullif(c2/nullif(b2,0) + c2/nullif(a2,0), 0)"

RELATIONS["line_cells"] = (
    ("line_labels",),
    "SELECT key, truth, pred, count(*) AS n FROM line_labels GROUP BY key, truth, pred",
)
RELATIONS["line_totals"] = (("line_cells",), cells_totals("line_cells", "key"))
RELATIONS["aligned"] = (
    ("line_labels",),
    """SELECT a.dataset, a.key, a.truth, b.pred, count(*) AS n FROM line_labels a JOIN line_labels b
    ON a.dataset = b.dataset AND a.key = b.key AND a.instance = b.instance GROUP BY ALL""",
)
RELATIONS["aligned_totals"] = (("aligned",), cells_totals("aligned", "dataset", "key"))
RELATIONS["nested_totals"] = (("nested_cells",), cells_totals("nested_cells", "word"))

# one training round
RELATIONS["weights"] = (
    ("pairs", "train_z", "tree"),
    f"""SELECT x, sense, node_id, sum(w) AS w, sum(w * code) AS w1 FROM (
        SELECT x, y, sense, sum(z) AS w FROM (
            SELECT pairs.x, y, unnest([1, 2, 3]) AS sense, unnest([z1, z2, z3]) AS z
            FROM pairs JOIN train_z USING (doc_id, chunk_id, pos)) WHERE z >= {THRESHOLD} GROUP BY x, y, sense)
    JOIN tree ON tree.word_id = y GROUP BY x, sense, node_id""",
)
RELATIONS["pulls"] = (
    ("weights", "node_f"),
    f"SELECT x, sense, node_id, w, {LR} * (w - w1 - w / (1 + exp(-f))) AS g FROM weights JOIN node_f USING (x, sense, node_id)",
)
RELATIONS["in_grad"] = (
    ("pulls", "out_vec"),
    """SELECT x AS id, sense, i, sum(g * vec[i + 1]::DOUBLE) AS grad, sum(w) AS weight
    FROM pulls JOIN out_vec USING (node_id), range(0, 8) r(i) GROUP BY x, sense, i""",
)
RELATIONS["out_grad"] = (
    ("pulls", "in_vec"),
    """SELECT p.node_id AS id, 0 AS sense, i, sum(g * vec[i + 1]::DOUBLE) AS grad, sum(w) AS weight
    FROM pulls p JOIN in_vec v ON v.word_id = p.x AND v.sense = p.sense, range(0, 8) r(i) GROUP BY p.node_id, i""",
)
# What a round of training computes anew from its tokens and the model so far.
ROUND = ("pair_counts", "node_f", "node_wide", "pair_steps", "pair_ll", "context_ll", "train_z", "weights", "pulls", "in_grad", "out_grad")


def training(rounds: int, params: TrainParams) -> None:
    """Relations of chained rounds: those of a single round under names of their own, and the model that each leaves behind."""
    draw = f"{mixed('doc_id', 'chunk_id', '0', params.seed)} % {rounds}"
    scale = 1.0 / params.dim
    zeros = f"list_transform(range(0, {DIM}), lambda i: 0.0::DOUBLE)"
    RELATIONS["t_total"] = (("tokens",), "SELECT count(*)::DOUBLE AS total FROM tokens")
    RELATIONS["t_in0"] = (
        ("vocab",),
        f"""SELECT word_id, sense, {random_vec('word_id', 'sense', params.seed, scale)} AS vec, {zeros} AS acc
        FROM vocab, range(1, {SENSES + 1}) s(sense)""",
    )
    RELATIONS["t_out0"] = (
        ("vocab",),
        f"""SELECT node_id, {random_vec('node_id', '0', params.seed, scale)} AS vec, {zeros} AS acc
        FROM (SELECT word_id - 1 AS node_id FROM vocab WHERE word_id > 1)""",
    )
    RELATIONS["t_counts0"] = (("vocab",), "SELECT word_id, freq, freq::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3 FROM vocab")
    for r in range(rounds):
        names = {name: f"t_{name}{r}" for name in ROUND}
        names |= {"tokens": f"t_tokens{r}", "pairs": f"t_pairs{r}", "in_vec": f"t_in{r}", "out_vec": f"t_float{r}"}
        names |= {"sense_counts": f"t_counts{r}", "prior": f"t_prior{r}"}

        def own(text: str, names: dict[str, str] = names) -> str:
            return re.sub(rf"\b({'|'.join(names)})\b", lambda m: names[m[0]], text)

        behind = "row_number() OVER (PARTITION BY word_id ORDER BY doc_id DESC, chunk_id DESC, pos DESC) - 1 AS behind"
        RELATIONS[f"t_tokens{r}"] = (("tokens",), f"SELECT *, {behind} FROM tokens WHERE {draw} = {r}")
        RELATIONS[f"t_pairs{r}"] = (("pairs",), f"SELECT * FROM pairs WHERE {draw} = {r}")
        rate = f"greatest({params.start_lr} * (1 - total * {r} / {rounds} / (total + 1)), {params.start_lr * 1e-4})"
        RELATIONS[f"t_rate{r}"] = (("t_total",), f"SELECT {rate} AS lr FROM t_total")
        # scores read node vectors in single precision
        RELATIONS[f"t_float{r}"] = (
            (f"t_out{r}",),
            f"SELECT node_id, list_transform(vec, lambda e: e::FLOAT::DOUBLE) AS vec FROM t_out{r}",
        )
        RELATIONS[f"t_prior{r}"] = ((f"t_counts{r}",), own(_sticks(params.alpha, params.d)))
        for name in ROUND:
            needed, text = RELATIONS[name]
            RELATIONS[names[name]] = (tuple(names.get(n, n) for n in needed), own(text))
        for side, key, grad in (("in", "word_id, sense", "in_grad"), ("out", "node_id", "out_grad")):
            same = " AND ".join(f"g.{'id' if k == key.split(',')[0] else k} = b.{k}" for k in key.split(", "))
            total = f"(acc + pow(grad / {LR}, 2))"
            step = f"CASE WHEN {total} > 0 THEN {params.pace} * lr * grad / {LR} / sqrt({total}) ELSE 0 END"
            RELATIONS[f"t_{side}{r + 1}"] = (
                (f"t_{side}{r}", names[grad], f"t_rate{r}"),
                f"""SELECT {key}, list(v ORDER BY i) AS vec, list(acc ORDER BY i) AS acc FROM (
                    SELECT {', '.join('b.' + k for k in key.split(', '))}, b.i, v + coalesce({step}, 0) AS v, coalesce({total}, acc) AS acc
                    FROM (SELECT {key}, unnest(vec) AS v, unnest(acc) AS acc, unnest(range(0, {DIM})) AS i FROM t_{side}{r}) b
                    LEFT JOIN {names[grad]} g ON {same} AND g.i = b.i CROSS JOIN t_rate{r}) GROUP BY {key}""",
            )
        late = ", ".join(f"sum(z{k} * pow(1 - lr, behind)) AS t{k}" for k in KS)
        moved = ", ".join(f"coalesce(c{k} * pow(1 - lr, m) + lr * freq * t{k}, c{k}) AS c{k}" for k in KS)
        RELATIONS[f"t_counts{r + 1}"] = (
            (f"t_counts{r}", names["train_z"], f"t_tokens{r}", f"t_rate{r}"),
            f"""SELECT word_id, freq, {moved} FROM t_counts{r} LEFT JOIN (
                SELECT x, count(*) AS m, {late} FROM {names['train_z']} JOIN t_tokens{r} USING (doc_id, chunk_id, pos) CROSS JOIN t_rate{r} GROUP BY x
            ) ON x = word_id CROSS JOIN t_rate{r}""",
        )
        value = " + ".join(f"CASE WHEN z{k} >= {THRESHOLD} THEN z{k} * ll{k} ELSE 0 END" for k in KS)
        senses = " + ".join(f"(p{k} >= 0.001)::INT" for k in KS)
        RELATIONS[f"t_stats{r}"] = (
            (f"t_pairs{r}", names["train_z"], names["pair_ll"], f"t_tokens{r}", f"t_prior{r}", f"t_rate{r}"),
            f"""SELECT 0 AS epoch, {r} AS round, lr, occurrences, pairs, mean_ll, mean_senses, max_senses, {(r + 1) / rounds}::DOUBLE AS share_read
            FROM (SELECT count(*) AS pairs, sum({value}) / count(*) AS mean_ll FROM t_pairs{r}
                JOIN {names['train_z']} USING (doc_id, chunk_id, pos, x) JOIN {names['pair_ll']} USING (x, y))
            CROSS JOIN (SELECT count(*) AS occurrences, avg({senses}) AS mean_senses, max({senses}) AS max_senses
                FROM t_tokens{r} JOIN t_prior{r} USING (word_id)) CROSS JOIN t_rate{r}""",
        )
    RELATIONS["t_stats"] = (
        tuple(f"t_stats{r}" for r in range(rounds)), " UNION ALL ".join(f"SELECT * FROM t_stats{r}" for r in range(rounds))
    )
    RELATIONS["t_prior"] = ((f"t_counts{rounds}",), re.sub(r"\bsense_counts\b", f"t_counts{rounds}", _sticks(params.alpha, params.d)))


training(TRAINING.rounds, TRAINING)

_step = f"coalesce(grad * least(1, {CAP} / weight), 0)"


def bind(final: str, *needed: str) -> str:
    """``final`` behind the relations it needs, each computed once."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in RELATIONS[name][0]:
                visit(other)
            order.append(name)

    for name in needed:
        visit(name)
    if not order:
        return final
    parts = []
    for name in order:
        kind = "" if name in RECURSIVE else " MATERIALIZED"
        parts.append(f"{name} AS{kind} ({RELATIONS[name][1]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


def wide(prefix: str, digits: int = 6) -> str:
    return ", ".join(f"round({prefix}{k}, {digits}) AS {prefix}{k}" for k in KS)


def long(prefix: str, name: str, relation: str, key: str, digits: int = 6) -> str:
    values = ", ".join(f"{prefix}{k}" for k in KS)
    ks = ", ".join(str(k) for k in KS)
    return f"""SELECT {key}, sense, round(v, {digits}) AS {name} FROM (
        SELECT {key}, unnest([{ks}]) AS sense, unnest([{values}]) AS v FROM {relation})"""


def pair_checks(pairs: str) -> str:
    return f"""SELECT doc_id, chunk_id, count(*) AS pairs,
        sum((pos::BIGINT * 1000003 + x::BIGINT * 8191 + y) % {PRIME})::BIGINT AS checksum
        FROM ({pairs}) GROUP BY doc_id, chunk_id"""


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["scan_words"] = bind("SELECT doc_id, pos, word FROM raw_words", "raw_words")
    o["encode_corpus"] = bind("SELECT doc_id, chunk_id, pos, word_id FROM tokens", "tokens")
    o["encode_text"] = bind(
        f"""SELECT doc_id, (pos - 1) // {BATCH} AS chunk_id, word_id,
            row_number() OVER (PARTITION BY doc_id, (pos - 1) // {BATCH} ORDER BY pos) AS pos
        FROM turn_words JOIN vocab USING (word)""",
        "turn_words",
        "vocab",
    )
    o["epoch_tokens"] = bind(
        f"""SELECT doc_id, epoch, count(*) AS n, sum((pos::BIGINT * 8191 + word_id) % {PRIME})::BIGINT AS checksum
        FROM tokens, range(0, 2) e(epoch) GROUP BY doc_id, epoch""",
        "tokens",
    )
    o["read_dictionary"] = bind(
        rf"""SELECT f[1] AS word, f[2]::BIGINT AS freq FROM (
            SELECT string_split(trim(regexp_replace(value, '{WHITE}', ' ', 'g')), ' ') AS f FROM (
                SELECT word || ' ' || count(*) AS value FROM raw_words GROUP BY word
                UNION ALL SELECT text FROM benchmark))
        WHERE regexp_full_match(coalesce(f[2], ''), '[+-]?[0-9]+') AND try_cast(f[2] AS BIGINT) IS NOT NULL""",
        "raw_words",
    )
    o["write_dictionary"] = bind("SELECT word || ' ' || freq AS line FROM counts", "counts")
    o["save_model_pruned"] = bind(
        f"""SELECT word_id, sense FROM (SELECT word_id, unnest([1, 2, 3]) AS sense, unnest([p1, p2, p3]) AS p FROM prior)
        WHERE p >= {KEEP}""",
        "prior",
    )
    o["load_model"] = bind(
        f"""SELECT 'vocab' AS name, count(*) AS n FROM vocab UNION ALL SELECT 'sense_counts', count(*) FROM sense_counts
        UNION ALL SELECT 'tree', count(*) FROM tree UNION ALL SELECT 'out_vec', count(*) FROM out_vec
        UNION ALL SELECT 'in_vec', sum((p1 >= {KEEP})::INT + (p2 >= {KEEP})::INT + (p3 >= {KEEP})::INT)::BIGINT FROM prior""",
        "vocab",
        "tree",
        "out_vec",
        "prior",
    )
    o["export_vectors"] = bind(
        f"""SELECT word_id, word, {DIM + 1} AS fields FROM vocab
        UNION ALL SELECT 0, count(*)::VARCHAR, 2 FROM vocab""",
        "vocab",
    )
    o["import_vectors"] = bind(
        f"""SELECT word, i, round(vec[i + 1]::DOUBLE, 6) AS value
        FROM in_vec JOIN vocab USING (word_id), range(0, {DIM}) r(i) WHERE sense = 1""",
        "in_vec",
        "vocab",
    )
    o["wsi_instances"] = bind(
        """SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS instance,
            array_to_string(ws[1:m - 1], ' ') AS left, array_to_string(ws[m + 1:len(ws)], ' ') AS right FROM inst""",
        "inst",
    )
    o["wsi_prediction_lines"] = bind(
        "SELECT key || ' ' || key || '.' || instance || ' ' || key || '.senses.' || sense AS line FROM inst_best", "inst_best"
    )
    o["read_answers"] = bind("SELECT key, instance, truth AS sense FROM line_labels", "line_labels")
    o["wwsi_contexts"] = bind(
        """SELECT doc_id, word, vocab.freq AS weight, lang AS sense, 1 AS sense_weight, false AS has_utf, 1 AS context_id,
            m - 1 AS position, len(ws) AS words FROM inst JOIN vocab USING (word)""",
        "inst",
        "vocab",
    )
    o["wwsi_nested_file"] = bind(
        """SELECT word, weight::INT AS weight, sense_no, lang AS sense, 1 AS sense_weight, accent = 1 AS has_utf, context_id,
            m - 1 AS position, array_to_string(ws, ' ') AS text FROM nested_numbers""",
        "nested_numbers",
    )
    o["stop_word_file"] = bind("SELECT word FROM stop_words", "stop_words")
    o["model_vectors"] = bind(
        f"""SELECT word_id, sense, i, round(vec[i + 1]::DOUBLE, 6) AS value
        FROM in_vec JOIN prior USING (word_id), range(0, {DIM}) r(i)
        WHERE (CASE sense WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) >= {KEEP}""",
        "in_vec",
        "prior",
    )
    o["reading_order"] = bind(
        "SELECT doc_id, min(place) AS first, max(place) AS last, count(*) AS n FROM ordered_tokens GROUP BY doc_id", "ordered_tokens"
    )
    o["later_occurrences"] = bind("SELECT doc_id, chunk_id, pos, behind FROM ordered_tokens", "ordered_tokens")
    o["tokenize_simple"] = f"SELECT page_id, {simple('html')} AS tokens FROM pages"
    o["clean_tokens"] = rf"""SELECT conv_id, turn, lower(array_to_string(list_filter(
        string_split_regex(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '{WHITE}'),
        lambda w: regexp_matches(w, '[A-Za-z0-9]')), ' ')) AS tokens FROM conversations"""
    o["blank_predicate"] = r"""SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_full_match(line, '[ \t]*')) AS blank
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"""
    o["strip_non_ascii"] = r"""SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS ascii,
        strlen(text) <> length(text) AS has_utf FROM conversations"""

    o["word_count"] = bind("SELECT word, freq FROM counts", "counts")
    o["vocab_min_freq"] = bind("SELECT word, freq FROM counts WHERE freq >= 5", "counts")
    o["vocab_stopwords"] = bind(
        "SELECT word, freq FROM counts WHERE word NOT IN (SELECT word FROM stop_words)", "counts", "stop_words"
    )
    o["vocab_regex"] = bind("SELECT word, freq FROM counts WHERE regexp_full_match(word, '[a-z]+')", "counts")
    ranked = "SELECT row_number() OVER (ORDER BY freq DESC, word) AS word_id, word, freq FROM "
    o["vocab_ids"] = bind(ranked + "counts", "counts")
    o["vocab_remove_top_k"] = bind(
        f"SELECT word_id - 70 AS word_id, word, freq FROM ({ranked} counts) WHERE word_id > 70", "counts"
    )
    o["build_vocab"] = bind(
        f"""SELECT word_id - 70 AS word_id, word, freq FROM ({ranked} (
            SELECT * FROM counts WHERE freq >= 5 AND regexp_full_match(word, '[a-z]+')
            AND word NOT IN (SELECT word FROM stop_words))) WHERE word_id > 70""",
        "counts",
        "stop_words",
    )
    o["build_from_text"] = bind(
        ranked + "(SELECT word, count(*) AS freq FROM raw_words GROUP BY word HAVING count(*) >= 5)", "raw_words"
    )
    o["lookup_word"] = bind(
        "SELECT word_id, word, count(*) AS n FROM turn_words JOIN vocab USING (word) GROUP BY word_id, word",
        "turn_words",
        "vocab",
    )
    o["vocab_total"] = bind("SELECT sum(freq)::BIGINT AS total FROM vocab", "vocab")
    total = "(SELECT sum(freq)::DOUBLE FROM vocab)"
    u = uniform("doc_id", "pos", "0", 1)
    o["subsample"] = bind(
        f"""SELECT v.word_id, v.freq, round(least(1.0, sqrt(0.001 * {total} / v.freq)), 6) AS keep, coalesce(drawn, 0) AS drawn
        FROM vocab v LEFT JOIN (SELECT word_id, count(*) AS drawn FROM tokens
            WHERE {u} >= 1 - sqrt(0.001 * {total} / freq) GROUP BY word_id) d ON d.word_id = v.word_id""",
        "tokens",
    )
    o["preprocess"] = bind(
        f"""SELECT word_id, count(*) AS n FROM tokens
        WHERE freq >= 50 AND {u} >= 1 - sqrt(0.0001 * {total} / freq) GROUP BY word_id""",
        "tokens",
    )

    o["huffman_total_cost"] = bind(
        """SELECT count(*) AS words, sum(freq * len)::BIGINT AS total_cost, sum(pow(2.0, -len)) AS kraft, max(len) AS max_depth,
            (SELECT count(DISTINCT node_id) FROM tree) AS nodes
        FROM (SELECT word_id, max(depth) AS len FROM tree GROUP BY word_id) JOIN vocab USING (word_id)""",
        "tree",
        "vocab",
    )
    o["huffman_codes"] = bind("SELECT word_id, depth, node_id, code FROM tree", "tree")
    o["huffman_depth"] = bind("SELECT word_id, max(depth) AS length FROM tree GROUP BY word_id", "tree")
    o["init_vectors"] = bind(
        f"""SELECT word_id, sense, i, round((({uniform('word_id', 'sense', 'i', 1)} - 0.5) * {1 / DIM})::FLOAT::DOUBLE, 9) AS value
        FROM vocab, range(1, {SENSES + 1}) s(sense), range(0, {DIM}) r(i)""",
        "vocab",
    )
    o["zero_vectors"] = bind(
        f"SELECT word_id, sense, {DIM} AS width, 0.0::DOUBLE AS norm FROM vocab, range(1, {SENSES + 1}) s(sense)", "vocab"
    )
    o["init_counts"] = bind(
        "SELECT word_id, freq::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3 FROM vocab", "vocab"
    )

    o["context_pairs"] = bind(pair_checks(pairs_joined(WINDOW)), "tokens")
    width = f"{WINDOW - 1} - {mixed('doc_id', 'pos', '0', 1)} % {WINDOW - 1}"
    cut = f"SELECT * FROM pairs JOIN (SELECT doc_id, chunk_id, pos, {width} AS width FROM tokens) USING (doc_id, chunk_id, pos)"
    o["context_cut"] = bind(pair_checks(f"{cut} WHERE abs(o) <= width"), "pairs")
    o["pair_counts"] = bind("SELECT x, y, n FROM pair_counts", "pair_counts")
    o["wsi_context"] = bind("SELECT key, instance, side, r, word_id FROM inst_context", "inst_context")
    o["wwsi_context"] = bind("SELECT word, sense, context_id, side, r, word_id FROM nested_context", "nested_context")

    o["expected_pi"] = bind(long("p", "p", "prior", "word_id", 8), "prior")
    o["expected_logpi"] = bind(long("l", "p", "prior", "word_id", 8), "prior")
    o["sense_count"] = bind(
        "SELECT word_id, (p1 >= 0.001)::INT + (p2 >= 0.001)::INT + (p3 >= 0.001)::INT AS senses FROM prior", "prior"
    )
    a, b = "(c1 + 1)", f"(c2 + {ALPHA})"
    o["beta_means"] = bind(
        f"""SELECT word_id, round({a}/({a}+{b}), 8) AS mean, round({digamma(a)} - {digamma(f'{a}+{b}')}, 8) AS meanlog,
            round({b}/({a}+{b}), 8) AS mirror, round({digamma(b)} - {digamma(f'{a}+{b}')}, 8) AS mirrorlog FROM sense_counts""",
        "sense_counts",
    )
    cell = "SELECT word_id, unnest(vec) AS e, unnest(range(0, len(vec))) AS i FROM "
    o["sigmoids"] = bind(
        f"""SELECT word_id, i, round(1 / (1 + exp(-e * 100)), 8) AS sigmoid, round({log_sigmoid('(e * 100)')}, 8) AS log_sigmoid
        FROM ({cell} vectors)""",
        "vectors",
    )
    o["softmax"] = bind(
        f"SELECT word_id, i, round(exp(e * 100) / sum(exp(e * 100)) OVER (PARTITION BY word_id), 8) AS value FROM ({cell} vectors)",
        "vectors",
    )
    o["log_skip_gram"] = bind(f"SELECT x, y, {wide('ll')} FROM pair_ll", "pair_ll")
    o["context_loglik"] = bind(long("ll", "ll", "context_ll", "doc_id, chunk_id, pos"), "context_ll")
    o["unit_vector"] = bind(
        "SELECT word_id, i, round(e / len, 8) AS value FROM "
        "(SELECT word_id, len, unnest(vec) AS e, unnest(range(0, len(vec))) AS i FROM norms)",
        "norms",
    )
    o["cos_dist"] = bind(
        """SELECT a.word_id, round(1 - list_dot_product(a.vec, b.vec) / (a.len * b.len), 8) AS distance
        FROM norms a JOIN norms b ON b.word_id = a.word_id + 1""",
        "norms",
    )
    o["sense_vector"] = bind(
        f"""SELECT word, sense, i, round(vec[i + 1]::DOUBLE, 6) AS value,
            round(vec[i + 1]::DOUBLE / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS unit
        FROM in_vec JOIN vocab USING (word_id) JOIN stop_words USING (word), range(0, {DIM}) r(i) WHERE sense <= 2""",
        "in_vec",
        "vocab",
        "stop_words",
    )
    o["model_shape"] = bind(
        "SELECT max(len(vec)) AS dim, max(sense) AS senses, count(DISTINCT word_id) AS words FROM in_vec", "in_vec"
    )

    o["train_posterior"] = bind(f"SELECT doc_id, chunk_id, pos, {wide('z')} FROM train_z", "train_z")
    o["gradient_round"] = bind(
        f"""SELECT side, id, sense, i, round(old + {_step}, 5) AS value FROM (
            SELECT 'in' AS side, word_id AS id, v.sense, r.i, vec[r.i + 1]::DOUBLE AS old, grad, weight
            FROM in_vec v CROSS JOIN range(0, {DIM}) r(i)
            LEFT JOIN in_grad g ON g.id = v.word_id AND g.sense = v.sense AND g.i = r.i
            UNION ALL
            SELECT 'out', node_id, 0, r.i, vec[r.i + 1]::DOUBLE, grad, weight
            FROM out_vec v CROSS JOIN range(0, {DIM}) r(i) LEFT JOIN out_grad g ON g.id = v.node_id AND g.i = r.i)""",
        "in_grad",
        "out_grad",
    )
    keep = f"pow(1 - {LR}, m)"
    moved = ", ".join(f"round(c{k} * {keep} + freq * t{k} / m * (1 - {keep}), 5) AS c{k}" for k in KS)
    o["update_counts"] = bind(
        f"""SELECT word_id, {moved} FROM sense_counts JOIN (
            SELECT x, count(*) AS m, {', '.join(f'sum(z{k}) AS t{k}' for k in KS)} FROM train_z GROUP BY x) ON x = word_id""",
        "sense_counts",
        "train_z",
    )
    late = ", ".join(f"sum(z{k} * pow(1 - {LR}, behind)) AS t{k}" for k in KS)
    in_order = ", ".join(f"round(c{k} * {keep} + {LR} * freq * t{k}, 5) AS c{k}" for k in KS)
    o["ordered_counts"] = bind(
        f"""SELECT word_id, {in_order} FROM sense_counts JOIN (
            SELECT x, count(*) AS m, {late} FROM train_z JOIN ordered_tokens USING (doc_id, chunk_id, pos) GROUP BY x) ON x = word_id""",
        "sense_counts",
        "train_z",
        "ordered_tokens",
    )
    o["train"] = bind(
        f"SELECT word, sense, p FROM ({long('p', 'p', 't_prior', 'word_id')}) JOIN vocab USING (word_id) WHERE p >= 0.001",
        "t_prior",
        "vocab",
    )
    o["train_loglik"] = bind("SELECT epoch, round, pairs, round(mean_ll, 6) AS mean_ll FROM t_stats", "t_stats")
    o["round_metrics"] = bind(
        """SELECT epoch, round, round(lr, 9) AS lr, occurrences, pairs, round(mean_ll, 6) AS mean_ll, round(mean_senses, 6) AS mean_senses,
            max_senses, round(share_read, 9) AS share_read FROM t_stats""",
        "t_stats",
    )
    o["lr_schedule"] = bind(
        f"""SELECT epoch, lang, read, round(greatest({LR} * (1 - read / (total + 1.0)), {LR * 1e-4}), 9) AS rate FROM (
            SELECT epoch, lang, coalesce(sum(n) OVER (ORDER BY epoch, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
                AS read, sum(n) OVER ()::BIGINT AS total
            FROM (SELECT lang, count(*) AS n FROM tokens JOIN documents USING (doc_id) GROUP BY lang), range(0, 2) e(epoch))""",
        "tokens",
    )

    o["disambiguate"] = bind(f"SELECT doc_id, chunk_id, pos, {wide('z')} FROM query_z", "query_z")
    o["disambiguate_no_prior"] = bind(f"SELECT doc_id, chunk_id, pos, {wide('z')} FROM plain_z", "plain_z")
    e = [f"exp(s{k} - greatest(s1, s2, s3))" for k in KS]
    z = ", ".join(f"round({e[k - 1]} / ({' + '.join(e)}), 6) AS z{k}" for k in KS)
    o["disambiguate_words"] = bind(f"SELECT doc_id, {z} FROM request_s", "request_s")
    o["nearest_to_vector"] = bind(
        """SELECT word_id, 1 AS sense, round(list_dot_product(vec, q) / len, 6) AS sim FROM norms, (
            SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(e) AS m FROM (
                SELECT unnest(vec) AS e, unnest(range(0, len(vec))) AS i FROM vectors) GROUP BY i))
        ORDER BY list_dot_product(vec, q) / len DESC, word_id LIMIT 10""",
        "norms",
    )
    o["nearest_neighbors"] = bind(
        """SELECT word_id, sense, round(sim, 6) AS sim FROM (
            SELECT c.word_id, c.sense, list_dot_product(c.v, q.v) / (c.len * q.len) AS sim FROM
                (SELECT word_id, sense, vec::DOUBLE[] AS v, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS len
                FROM in_vec JOIN sense_counts USING (word_id)
                WHERE (CASE sense WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END) >= 1) c,
                (SELECT vec::DOUBLE[] AS v, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS len
                FROM in_vec WHERE word_id = 1 AND sense = 1) q
            WHERE NOT (c.word_id = 1 AND c.sense = 1)) ORDER BY sim DESC, word_id, sense LIMIT 10""",
        "in_vec",
        "sense_counts",
    )
    o["nearest_words"] = bind(
        """SELECT word, sense, round(sim, 6) AS sim FROM (
            SELECT c.word_id, c.sense, list_dot_product(c.v, q.v) / (c.len * q.len) AS sim FROM
                (SELECT word_id, sense, vec::DOUBLE[] AS v, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS len
                FROM in_vec JOIN sense_counts USING (word_id)
                WHERE (CASE sense WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END) >= 1) c,
                (SELECT vec::DOUBLE[] AS v, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS len
                FROM in_vec WHERE word_id = 1 AND sense = 1) q
            WHERE NOT (c.word_id = 1 AND c.sense = 1)) JOIN vocab USING (word_id) ORDER BY sim DESC, word_id, sense LIMIT 10""",
        "in_vec",
        "sense_counts",
        "vocab",
    )
    o["nearest_neighbors_batch"] = bind(
        """SELECT query_id, rank, word_id, round(sim, 6) AS sim FROM (
            SELECT query_id, word_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, word_id) AS rank FROM (
                SELECT q.word_id AS query_id, c.word_id, list_dot_product(q.vec, c.vec) / (q.len * c.len) AS sim
                FROM norms q JOIN norms c ON c.word_id <> q.word_id)) WHERE rank <= 10""",
        "norms",
    )
    RELATIONS["values5"] = (("pair_ll", "prior"), _value(1e-5))
    o["likelihood"] = bind(
        "SELECT round(sum(n * v) / sum(n), 6) AS mean, sum(n)::BIGINT AS n FROM pair_counts JOIN values5 USING (x, y)",
        "pair_counts",
        "values5",
    )
    o["likelihood_by_doc"] = bind(
        """SELECT d.doc_id, coalesce(round(avg(s.v), 6), 0) AS mean, count(s.v) AS n
        FROM documents d LEFT JOIN (SELECT doc_id, v FROM pairs JOIN values5 USING (x, y)) s USING (doc_id) GROUP BY d.doc_id""",
        "pairs",
        "values5",
    )
    # the same relations over the wider window of this job
    saved = RELATIONS["pairs"]
    RELATIONS["pairs"] = (("tokens",), pairs_within(WSI_WINDOW))
    RELATIONS["values_wide"] = (("pair_ll", "prior"), _value(0.005))
    o["parallel_likelihood"] = bind(
        "SELECT round(sum(n * v) / sum(n), 6) AS mean, sum(n)::BIGINT AS n FROM pair_counts JOIN values_wide USING (x, y)",
        "pair_counts",
        "values_wide",
    )
    o["likelihood_log"] = bind(
        "SELECT doc_id, chunk_id, round(avg(v), 6) AS mean, count(*) AS n FROM pairs JOIN values_wide USING (x, y) GROUP BY doc_id, chunk_id",
        "pairs",
        "values_wide",
    )
    RELATIONS["pairs"] = saved
    o["sense_inventory"] = bind(
        f"SELECT word, sense, p FROM ({long('p', 'p', 'prior', 'word_id')}) JOIN vocab USING (word_id)", "prior", "vocab"
    )
    o["argmax_sense"] = bind(
        "SELECT doc_id, chunk_id, pos, CASE WHEN z1 >= z2 AND z1 >= z3 THEN 1 WHEN z2 >= z3 THEN 2 ELSE 3 END AS sense FROM query_z",
        "query_z",
    )

    o["wsi_predict"] = bind("SELECT key, instance, sense FROM inst_best", "inst_best")
    o["wwsi_contingency"] = bind("SELECT word, truth, pred, n FROM nested_cells", "nested_cells")
    o["wwsi_record_cells"] = bind(
        """SELECT word, truth, pred, count(*) AS n FROM (
            SELECT b.word, rec, sense_no AS truth, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS pred
            FROM nested_s b JOIN nested_numbers ON doc_id = b.context_id) GROUP BY word, rec, truth, pred""",
        "nested_s",
        "nested_numbers",
    )
    o["wwsi_mean_ari"] = bind(
        f"""SELECT count(*) AS words, round(avg(CASE WHEN t.word IS NULL THEN 0 ELSE {ARI} END), 6) AS mean_ari
        FROM (SELECT DISTINCT word FROM inst JOIN vocab USING (word) WHERE freq >= 500) e LEFT JOIN nested_totals t USING (word)""",
        "inst",
        "vocab",
        "nested_totals",
    )
    flags = "(SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL)"
    o["ari"] = f"SELECT round({ARI}, 6) AS ari FROM ({cells_totals(flags)})"
    o["ari_by_key"] = bind(f"SELECT key, round({ARI_EQUAL}, 8) AS ari FROM line_totals WHERE ac > 1", "line_totals")
    o["v_measure"] = bind(f"SELECT key, round({V_MEASURE}, 8) AS v FROM line_totals", "line_totals")
    o["paired_fscore"] = bind(f"SELECT key, round({F_SCORE}, 8) AS f FROM line_totals", "line_totals")
    o["wsi_summary"] = bind(
        f"""SELECT dataset, count(*) FILTER (ac <= 1) AS one_sense_keys, round(avg(ari), 8) AS mean_ari, round(avg(v), 8) AS mean_v,
            round(sum(v * cn) / sum(cn), 8) AS weighted_v, round(avg(f), 8) AS mean_f,
            round(sum(f * cn) / nullif(sum(cn) FILTER (f IS NOT NULL), 0), 8) AS weighted_f
        FROM (SELECT dataset, ac, cn, {ARI_EQUAL} AS ari, {V_MEASURE} AS v, {F_SCORE} AS f FROM aligned_totals) GROUP BY dataset""",
        "aligned_totals",
    )
    o["compensated_sum"] = (
        "SELECT l_returnflag, round(fsum(l_extendedprice), 2) AS total, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag"
    )
    o["stable_mean"] = (
        "SELECT l_linestatus, round(fsum(l_extendedprice) / count(*), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_linestatus"
    )
    o["merge_means"] = (
        "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_returnflag"
    )
    o["stream_word_count"] = o["word_count"]
    o["stream_disambiguate"] = o["disambiguate"]
    return o


def all_oracles() -> dict[str, str]:
    return _oracles()
