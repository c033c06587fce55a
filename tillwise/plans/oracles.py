"""The same results in plain SQL, for checking :mod:`tillwise.plans.queries`."""

from __future__ import annotations

# -- shared table expressions ---------------------------------------------

RAW = """
raw AS (
  SELECT l_orderkey AS doc_number_text, CAST(o_orderdate AS DATE) AS calday, l_partkey AS material,
    p_name AS material_text, p_brand AS matl_group,
    CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN 0.0
      WHEN l_orderkey % 13 = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
    l_returnflag = 'A' AS is_accessory, o_custkey AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
dirty AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE doc_number_text % 5 = 0),
ds1 AS (SELECT DISTINCT * FROM dirty WHERE quantity >= 0),
ds2 AS (SELECT * FROM ds1 WHERE quantity > 0)"""

TX = """
tx AS (
  SELECT o_custkey AS customer_id, l_partkey AS material, l_quantity AS quantity,
    CAST(o_orderdate AS DATE) AS calday
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _summary(source: str, name: str, item: str = "material") -> str:
    return f"""
{name} AS (
  SELECT customer_id, material AS {item}, count(quantity) AS transaction_count,
    sum(quantity) AS quantity_sum, min(calday) AS first_purchase, max(calday) AS last_purchase,
    date_diff('day', min(calday), max(calday)) AS time_diff_days
  FROM {source} GROUP BY customer_id, material)"""


PAIRS = TX + "," + _summary("tx", "pairs", "product_id")


def _coded(source: str) -> str:
    return _summary(source, "summary") + """,
ucode AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS normalized_customer_id
  FROM (SELECT DISTINCT customer_id FROM summary)),
icode AS (SELECT material, row_number() OVER (ORDER BY min(customer_id), material) - 1 AS product_id
  FROM summary GROUP BY material),
feat AS (SELECT customer_id, normalized_customer_id, material, product_id, transaction_count,
    quantity_sum, first_purchase, last_purchase, time_diff_days
  FROM summary JOIN ucode USING (customer_id) JOIN icode USING (material))"""


TIME = "first_purchase, last_purchase, customer_id, product_id"
COMPOSITE = """(0.5 * (CASE WHEN transaction_count > 4 THEN 4 WHEN transaction_count > 2 THEN 3
    WHEN transaction_count > 1 THEN 2 ELSE 1 END)
  + 0.5 * (CASE WHEN quantity_sum > 2 THEN 4 WHEN quantity_sum > 1 THEN 3
    WHEN quantity_sum > 1 THEN 2 ELSE 1 END))"""


def _bin(column: str) -> str:
    step = f"((hi_{column} - lo_{column}) / 4.0)"
    above = " + ".join(
        f"(CASE WHEN {column} > lo_{column} + {step} * {i} THEN 1 ELSE 0 END)" for i in (1, 2, 3)
    )
    return f"CASE WHEN hi_{column} = lo_{column} THEN 2 ELSE 1 + {above} END"


_BINNED = ("transaction_count", "quantity_sum", "time_diff_days")
RATED = PAIRS + """,
bounds AS (SELECT """ + ", ".join(
    f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in _BINNED
) + """ FROM pairs),
binned AS (SELECT customer_id, product_id, """ + ", ".join(
    f"{_bin(c)} AS normalized_{c}" for c in _BINNED
) + """ FROM pairs, bounds),
rated AS (SELECT *, normalized_time_diff_days * normalized_quantity_sum
    * normalized_transaction_count / 3.0 AS rating FROM binned)"""


def _md5(salt: str, *keys: str) -> str:
    return f"md5('{salt}:' || " + " || ':' || ".join(keys) + ")"


def _unit(digest: str) -> str:
    return f"(CAST(('0x' || substr({digest}, 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"


def _split(source: str, ratio: str = "0.8") -> str:
    return f"""
split AS (SELECT *, row_number() OVER (ORDER BY {_md5('split', 'customer_id', 'product_id')},
    customer_id, product_id) - 1 < floor((SELECT count(*) FROM {source}) * {ratio}) AS is_train
  FROM {source})"""


def _chunk(n: int) -> str:
    return f"ntile({n}) OVER (ORDER BY {TIME}) - 1"


# -- shuffles --------------------------------------------------------------

def _shuffled(source: str, name: str, salt: str) -> str:
    def side(tag: str, column: str) -> str:
        return f"""(SELECT {column}, row_number() OVER (ORDER BY
      {_md5(f'{salt}-{tag}', 'customer_id', 'product_id')}, customer_id, product_id) - 1 AS position
      FROM {source})"""

    return f"""
{name} AS (SELECT position, customer_id, product_id
  FROM {side('user', 'customer_id')} JOIN {side('item', 'product_id')} USING (position))"""


def _negatives(rounds: int = 3) -> str:
    parts = ["""
pool0 AS (SELECT customer_id, product_id, 0 AS generation, CAST(0 AS BIGINT) AS position FROM pairs)"""]
    for r in range(1, rounds + 1):
        parts.append(_shuffled(f"pool{r - 1}", f"made{r}", f"negative{r}"))
        parts.append(f"""
both{r} AS (SELECT * FROM pool{r - 1} UNION ALL
  SELECT customer_id, product_id, {r} AS generation, position FROM made{r}),
pool{r} AS (SELECT customer_id, product_id, min(generation) AS generation, min(position) AS position
  FROM both{r} b WHERE NOT EXISTS (SELECT 1 FROM pairs p
    WHERE p.customer_id = b.customer_id AND p.product_id = b.product_id)
  GROUP BY customer_id, product_id HAVING count(*) = 1)""")
    parts.append(f"""
negatives AS (SELECT customer_id, product_id, CAST(generation AS BIGINT) AS generation, position
  FROM pool{rounds} ORDER BY generation, position LIMIT (SELECT 2 * count(*) FROM pairs))""")
    return ",".join(parts)


NEGATIVES = PAIRS + "," + _negatives()
LABELLED = NEGATIVES + f""",
labelled AS (
  SELECT customer_id, product_id, 1 AS rating_type, {_chunk(5)} AS chunk FROM pairs
  UNION ALL
  SELECT customer_id, product_id, 0, ntile(5) OVER (ORDER BY generation, position) - 1 FROM negatives)"""

RATIO = PAIRS + f""",
numbered AS MATERIALIZED (SELECT customer_id, product_id, row_number() OVER (ORDER BY
    {_md5('ratio-row', 'customer_id', 'product_id')}) - 1 AS row_no FROM pairs),
draws AS (SELECT row_no * 3 + i AS draw FROM numbered, (SELECT unnest([0, 1, 2]) AS i)),
placed AS MATERIALIZED (SELECT draw, CAST(('0x' || substr({_md5('ratio-draw', 'draw')}, 1, 15)) AS BIGINT)
    % (SELECT count(*) FROM pairs) AS row_no FROM draws),
drawn AS MATERIALIZED (SELECT draw, customer_id, product_id FROM placed JOIN numbered USING (row_no)),
moved AS (SELECT row_number() OVER (ORDER BY {_md5('ratio-item', 'draw')}, draw) - 1 AS draw,
    product_id FROM drawn),
ratio AS (
  SELECT customer_id, product_id, CAST(1 AS DOUBLE) AS label, CAST(-1 AS BIGINT) AS draw FROM pairs
  UNION ALL
  SELECT d.customer_id, m.product_id, CAST(0 AS DOUBLE), draw FROM drawn d JOIN moved m USING (draw))"""


#: Draws that hit a pair take an unseen item of the user, by its place among the rows of the pairs.
UNSEEN = RATIO + f""",
again AS MATERIALIZED (SELECT r.draw, r.customer_id FROM ratio r JOIN pairs USING (customer_id, product_id) WHERE label = 0),
weight AS (SELECT product_id, count(*) AS w FROM pairs GROUP BY product_id),
open AS (SELECT u.customer_id, product_id, w, sum(w) OVER (PARTITION BY u.customer_id ORDER BY product_id) - w AS low,
    sum(w) OVER (PARTITION BY u.customer_id) AS total
  FROM (SELECT DISTINCT customer_id FROM again) u CROSS JOIN weight
  ANTI JOIN pairs p ON p.customer_id = u.customer_id AND p.product_id = weight.product_id),
total AS (SELECT customer_id, any_value(total) AS total FROM open GROUP BY customer_id),
number AS (SELECT draw, customer_id, CAST(('0x' || substr({_md5('ratio-unseen', 'draw')}, 1, 15)) AS BIGINT) % total AS n
  FROM again JOIN total USING (customer_id)),
unseen AS (
  SELECT customer_id, product_id, label, draw FROM ratio WHERE draw NOT IN (SELECT draw FROM again)
  UNION ALL
  SELECT n.customer_id, product_id, CAST(0 AS DOUBLE), draw FROM number n JOIN open o
    ON n.customer_id = o.customer_id AND n.n >= low AND n.n < low + w)"""


def _grown(rounds: int = 2) -> str:
    columns = "transaction_count, quantity_sum, first_purchase, last_purchase"
    parts = ["""
g0 AS (SELECT customer_id, product_id, transaction_count, quantity_sum, first_purchase, last_purchase FROM feat)"""]
    for r in range(1, rounds + 1):
        g = f"g{r - 1}"
        parts.append(f"""
rows{r} AS (SELECT row_number() OVER (ORDER BY {TIME}) - 1 AS position, {columns} FROM {g})""")
        parts.append(_shuffled(g, f"shuffled{r}", f"grow{r}"))

        def years(c: str) -> str:
            at = f"(SELECT year({c}) FROM rows{r} WHERE position = "
            return f"""CAST({c} + to_years(CAST({at} (SELECT max(position) FROM rows{r}))
        - {at} 1) AS INTEGER)) AS DATE) AS {c}"""

        parts.append(f"""
moved{r} AS (SELECT customer_id, product_id, transaction_count, quantity_sum,
    {years('first_purchase')}, {years('last_purchase')}, 1 AS generation, position
  FROM rows{r} JOIN shuffled{r} USING (position)),
g{r} AS (SELECT customer_id, product_id, {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, product_id ORDER BY generation, position) AS rn
  FROM (SELECT customer_id, product_id, {columns}, 0 AS generation, 0 AS position FROM {g}
    UNION ALL SELECT customer_id, product_id, {columns}, generation, position FROM moved{r}))
  WHERE rn = 1)""")
    return ",".join(parts)


# -- models ----------------------------------------------------------------

def _start(rank: int, scale: float = 1.0) -> str:
    def side(tag: str, column: str) -> str:
        cells = ", ".join(
            f"({_unit(_md5(f'start-{tag}{k}', column))} - 0.5) * CAST({scale} AS DOUBLE) AS f{k}"
            for k in range(rank)
        )
        return f"""SELECT {column} AS id, {cells}, CAST(0 AS DOUBLE) AS bias
  FROM (SELECT DISTINCT {column} FROM pairs)"""

    return f"""
u0 AS ({side('u', 'customer_id')}),
i0 AS ({side('i', 'product_id')})"""


def _dot(left: str, right: str, rank: int) -> str:
    return "(" + " + ".join(f"{left}.f{k} * {right}.f{k}" for k in range(rank)) + ")"


def _mf_step(
    r: int, rank: int, rate: float, penalty: float, offset: str, logit: bool, learn_bias: bool,
    tag: str = "",
) -> str:
    before = f"{r - 1}{tag if r > 1 else ''}"
    raw = f"{offset} + u.bias + i.bias + {_dot('u', 'i', rank)}"
    predicted = f"1.0 / (1.0 + exp(-({raw})))" if logit else raw

    def moved(side: str, key: str, other: str) -> str:
        cells = ", ".join(f"avg(error * {other}f{k}) AS g{k}" for k in range(rank))
        new = ", ".join(
            f"coalesce(m.f{k} + {rate} * (g{k} - {penalty} * m.f{k}), m.f{k}) AS f{k}"
            for k in range(rank)
        )
        bias = (
            f"coalesce(m.bias + {rate} * (gb - {penalty} * m.bias), m.bias)" if learn_bias else "m.bias"
        )
        return f"""{side}{r}{tag} AS (SELECT m.id, {new}, {bias} AS bias FROM {side}{before} m LEFT JOIN (
    SELECT {key} AS id, {cells}, avg(error) AS gb FROM e{r}{tag} WHERE is_train GROUP BY {key}) g ON m.id = g.id)"""

    cells = ", ".join(f"u.f{k} AS uf{k}, i.f{k} AS if{k}" for k in range(rank))
    return f"""
e{r}{tag} AS (SELECT customer_id, product_id, is_train, value - ({predicted}) AS error, {cells}
  FROM train{tag} JOIN u{before} u ON u.id = customer_id JOIN i{before} i ON i.id = product_id),
{moved('u', 'customer_id', 'i')},
{moved('i', 'product_id', 'u')}"""


def _model(r: int, rank: int) -> str:
    cells = ", ".join(f"round(f{k}, 6) AS f{k}" for k in range(rank))
    cells += ", round(bias, 6) AS bias"
    return f"SELECT 'u' AS side, id, {cells} FROM u{r} UNION ALL SELECT 'i', id, {cells} FROM i{r}"


MF = RATED + "," + _split("rated") + """,
train AS (SELECT customer_id, product_id, is_train, rating AS value FROM split),
mean AS (SELECT avg(value) AS g FROM train WHERE is_train),""" + _start(4)
MF_OFFSET = "(SELECT g FROM mean)"
MF_STEPS = [_mf_step(r, 4, 0.05, 0.02, MF_OFFSET, False, True) for r in (1, 2)]


def _mse(r: int) -> str:
    error = f"(value - ({MF_OFFSET} + u.bias + i.bias + {_dot('u', 'i', 4)}))"
    return f"""SELECT CAST({r} AS BIGINT) AS epoch,
  round(avg({error} * {error}) FILTER (WHERE is_train), 6) AS mse,
  round(avg({error} * {error}) FILTER (WHERE NOT is_train), 6) AS test_mse
FROM train JOIN u{r} u ON u.id = customer_id JOIN i{r} i ON i.id = product_id"""


TRIPLETS = """
liked AS (SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id
    ORDER BY product_id) - 1 AS place FROM pairs WHERE quantity_sum > 25),
other AS (SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id
    ORDER BY product_id) - 1 AS place, count(*) OVER (PARTITION BY customer_id) AS n
  FROM pairs WHERE NOT quantity_sum > 25),
triplets AS (SELECT l.customer_id, l.product_id AS positive, o.product_id AS negative, round_no AS "round"
  FROM liked l JOIN other o ON l.customer_id = o.customer_id
  JOIN (SELECT unnest([0, 1, 2, 3]) AS round_no) ON round_no < o.n AND o.place = (l.place + round_no) % o.n)"""

BPR = PAIRS + "," + TRIPLETS + "," + _start(4) + f""",
scored AS (SELECT customer_id, positive, negative,
    1.0 - 1.0 / (1.0 + exp(-({_dot('u', 'q', 4)} + q.bias - {_dot('u', 'r', 4)} - r.bias))) AS loss,
    {", ".join(f"u.f{k} AS p{k}, q.f{k} AS q{k}, r.f{k} AS r{k}" for k in range(4))}
  FROM triplets JOIN u0 u ON u.id = customer_id JOIN i0 q ON q.id = positive JOIN i0 r ON r.id = negative),
pulled AS (SELECT *, loss * (1.0 - loss) AS pull FROM scored),
ug AS (SELECT customer_id AS id, {", ".join(f"avg(pull * (q{k} - r{k})) AS g{k}" for k in range(4))},
    0.0 AS gb FROM pulled GROUP BY customer_id),
im AS (SELECT positive AS id, {", ".join(f"pull * p{k} AS m{k}" for k in range(4))}, pull AS mb FROM pulled
  UNION ALL SELECT negative, {", ".join(f"-pull * p{k}" for k in range(4))}, -pull FROM pulled),
ig AS (SELECT id, {", ".join(f"avg(m{k}) AS g{k}" for k in range(4))}, avg(mb) AS gb FROM im GROUP BY id),
""" + ",\n".join(
    f"""{side}1 AS (SELECT m.id, {", ".join(
        f"coalesce(m.f{k} + 0.5 * (g{k} - 0.02 * m.f{k}), m.f{k}) AS f{k}" for k in range(4))},
    coalesce(m.bias + 0.5 * (gb - 0.02 * m.bias), m.bias) AS bias
  FROM {side}0 m LEFT JOIN {side}g g ON m.id = g.id)""" for side in "ui"
)


#: The same over every triplet.
EVERY = PAIRS + """,
triplets AS (SELECT l.customer_id, l.product_id AS positive, o.product_id AS negative
  FROM pairs l JOIN pairs o ON l.customer_id = o.customer_id AND l.quantity_sum > 25 AND NOT o.quantity_sum > 25)"""
EVERY_BPR = BPR.replace(PAIRS + "," + TRIPLETS, EVERY)


def _network() -> str:
    """Probability of the fixed network over the pairs, layer by layer."""
    from tillwise.plans.queries import fixed_layers

    parts = [f"""WITH {PAIRS},{_start(8)},
x0 AS (SELECT p.customer_id, p.product_id, list_concat(u.f, i.f, list_transform(range(1, 9), lambda k: u.f[k] * i.f[k])) AS x
  FROM pairs p JOIN (SELECT id, [{", ".join(f"f{k}" for k in range(8))}] AS f FROM u0) u ON u.id = p.customer_id
  JOIN (SELECT id, [{", ".join(f"f{k}" for k in range(8))}] AS f FROM i0) i ON i.id = p.product_id)"""]
    layers = fixed_layers()
    for n, layer in enumerate(layers):
        cells = [f"list_dot_product(list_append(x, CAST(1 AS DOUBLE)), CAST({weights} AS DOUBLE[]))" for weights in layer]
        if n < len(layers) - 1:
            cells = [f"1.0 / (1.0 + exp(-{c}))" for c in cells]
        parts.append(f"x{n + 1} AS (SELECT customer_id, product_id, [{', '.join(cells)}] AS x FROM x{n})")
    return ",\n".join(parts) + f"""
SELECT customer_id, product_id, round(1.0 / (1.0 + exp(x[1] - x[2])), 6) AS probability FROM x{len(layers)}"""


# -- scoring ---------------------------------------------------------------

SCORES = _start(8) + f""",
scores AS (SELECT u.id AS customer_id, i.id AS product_id,
    round({_dot('u', 'i', 8)}, 9) AS score FROM u0 u, i0 i)"""


def _best(k: int) -> str:
    return f"""
best AS (SELECT customer_id, product_id, position FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS position
  FROM scores) WHERE position <= {k})"""


CHUNKED = PAIRS + f""",
chunked AS (SELECT *, {_chunk(5)} AS chunk FROM pairs)"""


def _confusion(truth: str, prefix: str = "") -> str:
    return f"""
SELECT tp AS {prefix}tp, total - tp - fp - (n_real - tp) AS {prefix}tn, fp AS {prefix}fp,
  n_real - tp AS {prefix}fn, tp / CAST(tp + fp AS DOUBLE) AS {prefix}"precision",
  tp / CAST(n_real AS DOUBLE) AS {prefix}recall, hit_users / CAST(n_users AS DOUBLE) AS {prefix}hit_rate
FROM (SELECT count(t.product_id) AS tp, count(*) - count(t.product_id) AS fp,
    count(DISTINCT CASE WHEN t.product_id IS NOT NULL THEN b.customer_id END) AS hit_users,
    (SELECT count(*) FROM {truth}) AS n_real,
    (SELECT count(DISTINCT customer_id) FROM pairs) AS n_users,
    (SELECT count(DISTINCT customer_id) FROM pairs) * (SELECT count(DISTINCT product_id) FROM pairs) AS total
  FROM best b LEFT JOIN {truth} t ON t.customer_id = b.customer_id AND t.product_id = b.product_id)""".replace(
        f'{prefix}"precision"', f'"{prefix}precision"'
    )


def _rounded(columns: str) -> str:
    names = columns.split()
    return ", ".join(
        f'round("{c}", 6) AS "{c}"' if c.endswith(("precision", "recall", "hit_rate")) else f'"{c}"'
        for c in names
    )


_METRICS = "tp tn fp fn precision recall hit_rate"


def _fold(f: int) -> str:
    """One epoch with fold f held out, its losses and its top 10 against the fold and all rows."""
    offset = f"(SELECT avg(value) FROM train_{f} WHERE is_train)"
    score = f"{offset} + u.bias + i.bias + {_dot('u', 'i', 50)}"
    return f"""
train_{f} AS (SELECT customer_id, product_id, rating AS value, chunk <> {f} AS is_train FROM folded),
{_mf_step(1, 50, 0.05, 0.02, offset, False, True, f"_{f}")},
loss_{f} AS (SELECT avg(pow(value - ({score}), 2)) FILTER (WHERE is_train) AS train_loss,
    avg(pow(value - ({score}), 2)) FILTER (WHERE NOT is_train) AS test_loss
  FROM train_{f} JOIN u1_{f} u ON u.id = customer_id JOIN i1_{f} i ON i.id = product_id),
best_{f} AS (SELECT customer_id, product_id FROM (
  SELECT u.id AS customer_id, i.id AS product_id,
    row_number() OVER (PARTITION BY u.id ORDER BY round({score}, 9) DESC, i.id) AS position
  FROM u1_{f} u, i1_{f} i) WHERE position <= 10),
held_{f} AS (SELECT customer_id, product_id FROM folded WHERE chunk = {f}),
row_{f} AS (SELECT CAST({f} AS BIGINT) AS fold, * FROM loss_{f},
  ({_confusion(f"held_{f}").replace("best b", f"best_{f} b")}),
  ({_confusion("pairs", "full_").replace("best b", f"best_{f} b")}))"""


CROSS_VALIDATION = RATED + f""",
folded AS (SELECT customer_id, product_id, rating, ntile(5) OVER (ORDER BY
    {_md5('folds', 'customer_id', 'product_id')}, customer_id, product_id) - 1 AS chunk FROM rated),
{_start(50)},""" + ",".join(_fold(f) for f in range(5))


def _stated(dates: str) -> str:
    return ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates.split())


def _quantiles(column: str, q: int) -> str:
    points = ", ".join(f"quantile_cont({column}, {i} / {float(q)})" for i in range(q + 1))
    return f"""SELECT '{column}' AS name, CAST({column} AS DOUBLE) AS value,
      (SELECT list_sort(list_distinct([{points}])) FROM (SELECT CAST({column} AS DOUBLE) AS {column} FROM pairs)) AS edges
    FROM pairs"""


FEATURE_COLUMNS = f"""customer_id, normalized_customer_id, material, product_id, transaction_count,
  quantity_sum, {_stated('first_purchase last_purchase')}, time_diff_days"""


def all_oracles() -> dict[str, str]:
    raw = f"""doc_number_text, {_stated('calday')}, material, material_text, matl_group, quantity,
  is_accessory, customer_id"""
    return {
        "flagship": f"WITH {RAW},{_coded('ds2')} SELECT {FEATURE_COLUMNS}, {_chunk(5)} AS chunk FROM feat",
        "curate_ds1": f"WITH {RAW} SELECT {raw} FROM ds1",
        "curate_ds2": f"WITH {RAW} SELECT {raw} FROM ds2",
        "mcq": f"""WITH {RAW},{_coded('ds2')}
SELECT customer_id, material, product_id, quantity_sum AS quantity FROM feat""",
        "interaction_features": f"WITH {RAW},{_coded('ds2')} SELECT {FEATURE_COLUMNS} FROM feat",
        "global_mean": f"WITH {PAIRS} SELECT count(*) AS n, round(avg({COMPOSITE}), 6) AS mean_rating FROM pairs",
        "dataset_profile": f"""WITH {PAIRS},
second AS (SELECT first_purchase AS d FROM pairs ORDER BY {TIME} LIMIT 1 OFFSET 1)
SELECT CAST(min(first_purchase) AS VARCHAR) AS first_day, CAST((SELECT d FROM second) AS VARCHAR) AS second_day,
  CAST(max(first_purchase) AS VARCHAR) AS last_day,
  date_diff('day', (SELECT d FROM second), max(first_purchase)) AS period_days,
  count(*) AS "rows", count(*) FILTER (WHERE time_diff_days > 0) AS positive_spans,
  count(*) FILTER (WHERE time_diff_days < 0) AS negative_spans,
  count(*) FILTER (WHERE time_diff_days = 0) AS zero_spans FROM pairs""",
        "first_non_null": f"""WITH {RAW},
ordered AS (SELECT *, CASE WHEN is_accessory THEN matl_group END AS flag, row_number() OVER (
    PARTITION BY customer_id, material
    ORDER BY calday, doc_number_text, is_accessory, coalesce(quantity, -1000.0)) AS rn FROM dirty)
SELECT customer_id, material, arg_min(quantity, rn) FILTER (WHERE quantity IS NOT NULL) AS quantity,
  arg_min(flag, rn) FILTER (WHERE flag IS NOT NULL) AS flag
FROM ordered GROUP BY customer_id, material""",
        "quantile_histogram": f"""WITH {PAIRS},
valued AS ({_quantiles('transaction_count', 4)} UNION ALL {_quantiles('quantity_sum', 4)}
  UNION ALL {_quantiles('time_diff_days', 5)}),
edged AS (SELECT name, any_value(edges) AS edges FROM valued GROUP BY name),
bins AS (SELECT name, edges, unnest(range(1, len(edges))) AS bin FROM edged),
filled AS (SELECT name, greatest(1, len(list_filter(edges, lambda e: e < value))) AS bin, count(*) AS n
  FROM valued GROUP BY ALL)
SELECT b.name, b.bin, round(b.edges[b.bin], 6) AS low, round(b.edges[b.bin + 1], 6) AS high,
  coalesce(f.n, 0) AS n FROM bins b LEFT JOIN filled f ON f.name = b.name AND f.bin = b.bin""",
        "equal_width_rating": f"""WITH {RATED} SELECT customer_id, product_id,
  {", ".join(f"CAST(normalized_{c} AS BIGINT) AS normalized_{c}" for c in _BINNED)},
  round(rating, 6) AS rating FROM rated""",
        "quartile_rating": f"""WITH {PAIRS} SELECT customer_id, product_id,
  CAST(CASE WHEN transaction_count > 4 THEN 4 WHEN transaction_count > 2 THEN 3
    WHEN transaction_count > 1 THEN 2 ELSE 1 END AS BIGINT) AS count_place,
  CAST(CASE WHEN quantity_sum > 2 THEN 4 WHEN quantity_sum > 1 THEN 3 ELSE 1 END AS BIGINT) AS quantity_place,
  CAST({COMPOSITE} AS DOUBLE) AS rating FROM pairs""",
        "shift_years": f"""WITH {PAIRS},
r AS (SELECT *, row_number() OVER (ORDER BY {TIME}) AS rn, count(*) OVER () AS n FROM pairs),
d AS (SELECT max(year(first_purchase)) FILTER (WHERE rn = n) - max(year(first_purchase)) FILTER (WHERE rn = 2) AS a,
    max(year(last_purchase)) FILTER (WHERE rn = n) - max(year(last_purchase)) FILTER (WHERE rn = 2) AS b FROM r)
SELECT customer_id, product_id,
  CAST(CAST(first_purchase + to_years(CAST(a AS INTEGER)) AS DATE) AS VARCHAR) AS first_purchase,
  CAST(CAST(last_purchase + to_years(CAST(b AS INTEGER)) AS DATE) AS VARCHAR) AS last_purchase FROM pairs, d""",
        "time_chunks": f"""WITH {CHUNKED}
SELECT customer_id, product_id, {_stated('first_purchase')}, chunk FROM chunked""",
        "random_split": f"""WITH {PAIRS},{_split('pairs')}
SELECT customer_id, product_id, CAST(is_train AS BIGINT) AS is_train FROM split""",
        "holdout_heavy_users": """WITH rated AS (
  SELECT o_custkey AS "user", l_partkey AS movie, l_quantity AS rating, l_orderkey, l_linenumber, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
firsts AS (SELECT *, row_number() OVER (PARTITION BY "user"
    ORDER BY l_orderkey, l_linenumber, movie, rating, l_extendedprice) AS rn,
    count(*) OVER (PARTITION BY "user") AS n FROM rated WHERE rating > 25),
test AS (SELECT * EXCLUDE (rn, n) FROM firsts WHERE n > 20 AND rn <= 2),
train AS (SELECT "user", movie, rating, l_orderkey, l_linenumber, l_extendedprice
  FROM (SELECT * FROM rated UNION ALL SELECT * FROM test) GROUP BY ALL HAVING count(*) = 1)
SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' FROM test""",
        "ground_truth": f"""WITH {PAIRS},
ranked AS (SELECT customer_id, product_id, (row_number() OVER (PARTITION BY customer_id
    ORDER BY product_id) - 1) // 16 AS block FROM pairs WHERE quantity_sum > 25)
SELECT customer_id, block, count(*) AS n, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY product_id) AS items
FROM ranked GROUP BY customer_id, block""",
        "cv_folds": f"""WITH {CHUNKED},
folds AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold)
SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (WHERE chunk <> fold) AS train_rows,
  count(*) FILTER (WHERE chunk = fold) AS test_rows,
  round(avg(quantity_sum) FILTER (WHERE chunk <> fold), 6) AS train_mean,
  round(avg(quantity_sum) FILTER (WHERE chunk = fold), 6) AS test_mean
FROM chunked, folds GROUP BY fold""",
        "cv_posneg_folds": f"""WITH {LABELLED},
folds AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold)
SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (WHERE chunk <> fold) AS train_rows,
  count(*) FILTER (WHERE chunk = fold AND rating_type = 1) AS test_rows,
  round(avg(rating_type) FILTER (WHERE chunk <> fold), 6) AS train_mean,
  round(avg(rating_type) FILTER (WHERE chunk = fold AND rating_type = 1), 6) AS test_mean
FROM labelled, folds GROUP BY fold""",
        "catalogues": f"""WITH {PAIRS} SELECT DISTINCT 'user' AS kind, customer_id AS id FROM pairs
UNION ALL SELECT DISTINCT 'item', product_id FROM pairs""",
        "cardinalities": f"""WITH {PAIRS},
half AS (SELECT * FROM pairs ORDER BY {TIME} LIMIT (SELECT count(*) // 2 FROM pairs))
SELECT max(customer_id) + 1 AS user_rows, max(product_id) + 1 AS item_rows,
  count(DISTINCT customer_id) AS users, count(DISTINCT product_id) AS items, count(*) AS pairs FROM half""",
        "oov_lookup": f"""WITH {PAIRS},
chunked AS (SELECT *, {_chunk(50)} AS chunk FROM pairs),
codes AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS code
  FROM (SELECT DISTINCT customer_id FROM chunked WHERE chunk = 0))
SELECT customer_id, product_id, coalesce(code, -1) AS code
FROM chunked LEFT JOIN codes USING (customer_id) WHERE chunk > 0""",
        "positive_pairs": f"WITH {TX} SELECT DISTINCT customer_id, material FROM tx",
        "complement": f"""WITH {PAIRS},
codes AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS code
  FROM (SELECT DISTINCT product_id FROM pairs)),
users AS (SELECT DISTINCT customer_id FROM pairs),
unseen AS (SELECT customer_id, code FROM users, codes
  WHERE (customer_id, product_id) NOT IN (SELECT (customer_id, product_id) FROM pairs)),
runs AS (SELECT customer_id, code, code - row_number() OVER (PARTITION BY customer_id ORDER BY code) AS run FROM unseen)
SELECT customer_id, min(code) AS first_code, max(code) AS last_code FROM runs GROUP BY customer_id, run""",
        "rated_triplets": f"""WITH {PAIRS},
numbered AS (SELECT customer_id, product_id, quantity_sum > 25 AS liked,
    row_number() OVER (PARTITION BY customer_id, quantity_sum > 25 ORDER BY product_id) - 1 AS place,
    count(*) FILTER (WHERE quantity_sum > 25) OVER (PARTITION BY customer_id) AS positives,
    count(*) FILTER (WHERE NOT quantity_sum > 25) OVER (PARTITION BY customer_id) AS negatives FROM pairs)
SELECT * FROM numbered WHERE positives > 0 AND negatives > 0""",
        "triplet_counts": f"""WITH {PAIRS},
sides AS (SELECT customer_id, count(*) FILTER (WHERE quantity_sum > 25) AS positives,
    count(*) FILTER (WHERE NOT quantity_sum > 25) AS negatives FROM pairs GROUP BY customer_id)
SELECT *, positives * negatives AS triplets FROM sides WHERE positives > 0 AND negatives > 0""",
        "catalogue_triplets": f"""WITH {PAIRS},
codes AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS code
  FROM (SELECT DISTINCT product_id FROM pairs)),
coded AS (SELECT customer_id, code FROM pairs JOIN codes USING (product_id)),
users AS (SELECT customer_id, count(*) AS n_seen, (SELECT count(*) FROM codes) - count(*) AS n_unseen
  FROM coded GROUP BY customer_id),
unseen AS (SELECT customer_id, code FROM users, codes
  WHERE (customer_id, code) NOT IN (SELECT (customer_id, code) FROM coded)),
runs AS (SELECT customer_id, code, code - row_number() OVER (PARTITION BY customer_id ORDER BY code) AS run FROM unseen),
both_ AS (SELECT customer_id, true AS seen, code AS first_code, code AS last_code FROM coded
  UNION ALL SELECT customer_id, false, min(code), max(code) FROM runs GROUP BY customer_id, run)
SELECT both_.*, n_seen, n_unseen FROM both_ JOIN users USING (customer_id)""",
        "transactions_csv": f"""WITH {RAW}
SELECT CAST(doc_number_text AS VARCHAR) AS doc_number_text, CAST(calday AS VARCHAR) AS calday,
  CAST(material AS VARCHAR) AS material, '"' || material_text || '", ' || matl_group AS material_text, matl_group,
  quantity, is_accessory, CAST(customer_id AS VARCHAR) AS customer_id FROM dirty""",
        "chunk_files": f"""WITH {PAIRS}
SELECT customer_id, product_id, quantity_sum, {_chunk(5)} AS chunk FROM pairs""",
        "renamed_csv": f"WITH {PAIRS} SELECT customer_id, product_id, quantity_sum FROM pairs",
        "ratings_tsv": f"""WITH {PAIRS}
SELECT 'ü' || customer_id AS user_id, 'é' || product_id AS movie_id, CAST(transaction_count AS DOUBLE) AS rating FROM pairs""",
        "binary_feedback": f"""WITH {PAIRS}
SELECT 'ü' || customer_id AS user_id, 'é' || product_id AS movie_id, CAST(1 AS DOUBLE) AS rating FROM pairs""",
        "labelled_pair_files": f"""WITH {PAIRS}
SELECT printf('%08d', customer_id) AS customer_id, 'm, ' || product_id AS material,
  CAST(CASE WHEN quantity_sum > 25 THEN 1 ELSE 0 END AS BIGINT) AS rating_type FROM pairs""",
        "chunk_csv": f"""WITH {PAIRS}
SELECT customer_id, product_id, quantity_sum, {_chunk(5)} AS chunk FROM pairs""",
        "appended_pairs": f"WITH {PAIRS} SELECT customer_id, product_id, quantity_sum FROM pairs",
        "stored_model": f"WITH {PAIRS},{_start(4, 2.0)} {_model(0, 4)}",
        "run_records": f"""WITH {PAIRS}
SELECT '{{"least": ' || least || '}}' AS config, count(*) AS n, round(avg(quantity_sum), 6) AS mean
FROM pairs, (VALUES (0), (25)) t(least) WHERE quantity_sum > least GROUP BY least""",
        "sparse_matrix": f"""WITH {PAIRS}
SELECT customer_id, product_id // 512 AS block, count(DISTINCT product_id) AS ones,
  string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY product_id) AS codes
FROM pairs GROUP BY customer_id, product_id // 512""",
        "synthetic_pairs": f"""WITH {PAIRS},
placed AS (SELECT row_number() OVER (ORDER BY {TIME}) - 1 AS position, first_purchase, quantity_sum FROM pairs),
{_shuffled('pairs', 'shuffled', 'synthetic')}
SELECT position, customer_id, product_id, {_stated('first_purchase')}, quantity_sum
FROM placed JOIN shuffled USING (position)""",
        "grown_dataset": f"""WITH {TX},{_coded('tx')},{_grown()}
SELECT customer_id, normalized_customer_id, material, product_id, transaction_count, quantity_sum,
  {_stated('first_purchase last_purchase')}, date_diff('day', first_purchase, last_purchase) AS time_diff_days
FROM (SELECT * FROM g2 ORDER BY {TIME} LIMIT (SELECT 2 * count(*) FROM feat))
JOIN ucode USING (customer_id) JOIN icode USING (product_id)""",
        "tt_dataset": f"""WITH {TX},{_coded('tx')}
SELECT customer_id, normalized_customer_id, material, product_id, {_chunk(5)} AS chunk FROM feat""",
        "negative_feedback": f"WITH {NEGATIVES} SELECT * FROM negatives",
        "ncf_dataset": f"""WITH {LABELLED}
SELECT customer_id, product_id, CAST(rating_type AS BIGINT) AS rating_type, chunk FROM labelled""",
        "ratio_negatives": f"WITH {RATIO} SELECT * FROM ratio",
        "ratio_negatives_unseen": f"WITH {UNSEEN} SELECT * FROM unseen",
        "binary_matrix": "WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
        + " SELECT user_id, "
        + ", ".join(f"CAST(max(CASE WHEN k = {k} THEN 1 ELSE 0 END) AS BIGINT) AS k_{k}" for k in range(100))
        + " FROM e GROUP BY user_id",
        "mf_step": f"WITH {MF},{MF_STEPS[0]} {_model(1, 4)}",
        "mf_epochs": f"WITH {MF},{MF_STEPS[0]},{MF_STEPS[1]} {_mse(1)} UNION ALL {_mse(2)}",
        "svd_cross_validation": f"""WITH {CROSS_VALIDATION}
SELECT fold, round(train_loss, 6) AS train_loss, round(test_loss, 6) AS test_loss, {_rounded(_METRICS)},
  {_rounded(' '.join('full_' + m for m in _METRICS.split()))}
FROM ({" UNION ALL ".join(f"SELECT * FROM row_{f}" for f in range(5))})""",
        "logistic_step": f"""WITH {RATIO},
train AS (SELECT customer_id, product_id, true AS is_train, label AS value FROM ratio),{_start(4)},
{_mf_step(1, 4, 0.5, 0.02, '0.0', True, False)} {_model(1, 4)}""",
        "bpr_step": f"WITH {BPR} {_model(1, 4)}",
        "bpr_epoch": f"WITH {EVERY_BPR} {_model(1, 4)}",
        "bpr_epoch_loss": f"WITH {EVERY_BPR} SELECT round(avg(loss), 6) AS loss, count(*) AS triplets FROM scored",
        "network_scores": _network(),
        "bpr_loss": f"WITH {BPR} SELECT round(avg(loss), 6) AS loss, count(*) AS triplets FROM scored",
        "score_all": f"""WITH {PAIRS},{SCORES} SELECT customer_id, count(*) AS n_items,
  round(avg(score), 6) AS mean_score, round(min(score), 6) AS least_score, round(max(score), 6) AS best_score
FROM scores GROUP BY customer_id""",
        "vector_topk": """WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
means AS (SELECT CAST(label AS BIGINT) AS query_id, ["""
        + ", ".join(f"avg(e[{k}])" for k in range(1, 65))
        + """] AS m FROM v GROUP BY label),
scored AS (SELECT query_id, vec_id, round(list_dot_product(m, e), 9) AS score FROM means, v),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS position FROM scored)
SELECT query_id, vec_id, round(score, 6) AS score, position FROM placed WHERE position <= 10""",
        "topn_table": f"""WITH {PAIRS},{_start(8, 4.0)},
scores AS (SELECT u.id AS customer_id, i.id AS product_id, round({_dot('u', 'i', 8)}, 9) AS score FROM u0 u, i0 i),
open AS (SELECT * FROM scores s WHERE score < 1.0 AND NOT EXISTS (SELECT 1 FROM pairs p
    WHERE p.customer_id = s.customer_id AND p.product_id = s.product_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS position FROM open)
SELECT customer_id, product_id, position, printf('%.9f', score) AS score FROM placed WHERE position <= 5""",
        "regression_error": f"""WITH {PAIRS},{_start(8)},
scored AS (SELECT {COMPOSITE} - round_even(round({_dot('u', 'i', 8)} + 3.0, 9), 2) AS e
  FROM pairs JOIN u0 u ON u.id = customer_id JOIN i0 i ON i.id = product_id)
SELECT round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse,
  round(avg(CASE WHEN abs(e) > 1 THEN 1.0 ELSE 0.0 END), 6) AS worst_share FROM scored""",
        "binary_metrics": f"""WITH {RATIO},{_start(8)},
scored AS (SELECT label, round(1.0 / (1.0 + exp(-{_dot('u', 'i', 8)})), 9) AS p
  FROM ratio JOIN u0 u ON u.id = customer_id JOIN i0 i ON i.id = product_id)
SELECT round(avg(CASE WHEN (p > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(-(label * ln(p) + (1.0 - label) * ln(1.0 - p))), 6) AS log_loss,
  count(*) FILTER (WHERE p > 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p > 0.5 AND label = 0) AS fp,
  count(*) FILTER (WHERE p <= 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE p <= 0.5 AND label = 1) AS fn
FROM scored""",
        "topk_confusion": f"""WITH {CHUNKED},{SCORES},{_best(10)},
held AS (SELECT customer_id, product_id FROM chunked WHERE chunk = 4),
a AS ({_confusion('held')}), b AS ({_confusion('pairs', 'full_')})
SELECT {_rounded(_METRICS)}, {_rounded(' '.join('full_' + m for m in _METRICS.split()))} FROM a, b""",
        "fold_average": f"""WITH {CHUNKED},{SCORES},{_best(10)},
{", ".join(f"h{f} AS (SELECT customer_id, product_id FROM chunked WHERE chunk = {f})" for f in range(5))},
folds AS ({" UNION ALL ".join(_confusion(f"h{f}") for f in range(5))})
SELECT {", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in _METRICS.split())}, count(*) AS folds FROM folds""",
        "auc": f"""WITH {PAIRS},{SCORES},
ranked AS (SELECT customer_id, product_id,
    rank() OVER (PARTITION BY customer_id ORDER BY score) + (count(*) OVER (PARTITION BY customer_id, score) - 1) / 2.0 AS mid,
    count(*) OVER (PARTITION BY customer_id) AS n FROM scores),
users AS (SELECT customer_id, sum(mid) AS s, count(*) AS m, any_value(n) AS n
  FROM ranked JOIN pairs USING (customer_id, product_id) WHERE quantity_sum > 25 GROUP BY customer_id)
SELECT round(avg((s - m * (m + 1) / 2.0) / (m * (n - m))), 6) AS auc, count(*) AS users FROM users WHERE m < n""",
        "map_at_k": f"""WITH {PAIRS},{SCORES},{_best(100)},
truth AS (SELECT customer_id, product_id FROM pairs WHERE quantity_sum > 25),
hits AS (SELECT customer_id, position, row_number() OVER (PARTITION BY customer_id ORDER BY position) AS h
  FROM best JOIN truth USING (customer_id, product_id)),
gain AS (SELECT customer_id, sum(h / CAST(position AS DOUBLE)) AS g FROM hits GROUP BY customer_id),
users AS (SELECT customer_id, count(*) AS m FROM truth GROUP BY customer_id)
SELECT round(avg(coalesce(g, 0) / least(m, 100)), 6) AS map_at_k, count(*) AS users
FROM users LEFT JOIN gain USING (customer_id)""",
        "stream_mean": "SELECT count(value) AS n, round(avg(value), 6) AS mean FROM events",
        "stream_ids": """SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) - 1 AS code
FROM events GROUP BY user_id""",
    }
