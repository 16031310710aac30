"""SQL building blocks shared by the registered queries."""

from __future__ import annotations

from evalspark.functions.text import BLANK

DOCS = "(SELECT doc_id AS row_id, lang AS label, text, source FROM documents)"
QUALITY = (
    "(SELECT d.doc_id AS row_id, d.text, CAST(l.quality AS VARCHAR) AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
ORDERS = (
    "(SELECT o_orderkey AS row_id, o_totalprice, c_acctbal, o_orderpriority, c_mktsegment, n_name, "
    "CAST(CAST(o_orderstatus = 'F' AS INTEGER) AS VARCHAR) AS label "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
)


def strip(expr: str) -> str:
    return rstrip(f"regexp_replace({expr}, '\\A{BLANK}', '')")


def rstrip(expr: str) -> str:
    return f"regexp_replace({expr}, '{BLANK}\\z', '')"


def shortened(expr: str, limit: int) -> str:
    cut = rstrip(f"substring({expr}, 1, {limit})")
    return f"CASE WHEN length({expr}) > {limit} THEN {cut} || ' …' ELSE {expr} END"


def h(purpose: str, row_id: str = "row_id") -> str:
    return f"sha256('42|{purpose}|' || {row_id})"


def quota(name: str, counts: str, total: str) -> str:
    """CTE ``name``(label, quota): ``total`` shared among counts(label, n) by largest remainder."""
    return f"""
{name}_size AS (SELECT CAST(sum(n) AS BIGINT) AS size, CAST(({total}) AS BIGINT) AS total FROM {counts}),
{name}_base AS (SELECT label, n * total // greatest(size, 1) AS base, n * total % greatest(size, 1) AS rem, total
  FROM {counts}, {name}_size),
{name} AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= total - sum(base) OVER ()
  THEN 1 ELSE 0 END AS quota FROM {name}_base)"""


def split(source: str, scored_n: int | None = None) -> str:
    """CTEs ending in ``split_rows``: the rows of ``source`` with split and is_scored."""
    scored = "sum(n)" if scored_n is None else f"least({scored_n}, sum(n))"
    return f"""
base_rows AS (SELECT *, {h('split')} AS h_split FROM {source}),
label_n AS (SELECT label, count(*) AS n FROM base_rows GROUP BY label),
{quota('train_q', 'label_n', 'sum(n) - ceil(sum(n) * 2 / 10.0)')},
test_n AS (SELECT label, label_n.n - train_q.quota AS n FROM label_n JOIN train_q USING (label)),
{quota('scored_q', 'test_n', scored)},
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h_split) AS place FROM base_rows),
split_rows AS (SELECT placed.* EXCLUDE (h_split, place), CASE WHEN place <= test_n.n THEN 'test' ELSE 'train' END AS split,
  place <= scored_q.quota AS is_scored
  FROM placed JOIN test_n USING (label) JOIN scored_q USING (label)),
train AS (SELECT * FROM split_rows WHERE split = 'train')"""


def shots(source: str, counts: str, short: str | None) -> str:
    """CTEs ending in ``shots``: the first counts(label, k) rows of each label, short ones preferred."""
    pool = "pool_all" if short is None else "pool_short"
    flag = "true" if short is None else f"({short})"
    return f"""
pool_flag AS (SELECT s.*, {flag} AS short, c.k FROM {source} s JOIN {counts} c USING (label)),
pool_size AS (SELECT label, sum(CAST(short AS INTEGER)) AS n_short FROM pool_flag GROUP BY label),
pool_all AS (SELECT p.* FROM pool_flag p),
pool_short AS (SELECT p.* FROM pool_flag p JOIN pool_size z USING (label) WHERE p.short OR z.n_short < p.k),
shots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h('shots')}) AS pick FROM {pool})
  WHERE pick <= k)"""


def metric_columns(pred: str, labels: list[str], by: str, positive: str | None) -> str:
    """A query of n, accuracy, macro_f1 (and f1_positive, roc_auc) per group over pred(label, pred, score)."""
    f1 = {
        l: f"coalesce(2.0 * count(*) FILTER (WHERE label = '{l}' AND pred = '{l}') / nullif(count(*) FILTER "
        f"(WHERE label = '{l}') + count(*) FILTER (WHERE pred = '{l}'), 0), 0.0)"
        for l in labels
    }
    macro = "(" + " + ".join(f1.values()) + f") / {len(labels)}"
    base = f"""SELECT {by}, count(*) AS n, round(avg(CAST(label = pred AS INTEGER)), 6) AS accuracy,
  round({macro}, 6) AS macro_f1"""
    if positive is None:
        return f"{base} FROM {pred} GROUP BY {by}"
    return f"""SELECT m.*, round(a.auc, 6) AS roc_auc FROM
({base}, round({f1[positive]}, 6) AS f1_positive FROM {pred} GROUP BY {by}) m LEFT JOIN ({auc(pred, by, positive)}) a USING ({by})"""


def auc(pred: str, by: str, positive: str) -> str:
    return f"""SELECT {by}, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) END AS auc
FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT {by}, score, CAST(count(*) FILTER (WHERE label = '{positive}') AS DOUBLE) AS p,
    CAST(count(*) FILTER (WHERE label <> '{positive}') AS DOUBLE) AS q
    FROM {pred} WHERE score IS NOT NULL GROUP BY {by}, score)) GROUP BY {by}"""
