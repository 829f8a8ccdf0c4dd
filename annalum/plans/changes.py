"""Changes over several tables: deletes that cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.plans.catalog import query
from annalum.schema import Tables
from annalum.sources import sinks

_COUNTED = "SELECT '{t}' AS table_name, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS deleted, coalesce(sum({k}) FILTER (NOT gone), 0)::BIGINT AS kept_sum, coalesce(sum({k}) FILTER (gone), 0)::BIGINT AS deleted_sum FROM {t}_g"


@query(f"""WITH customer_g AS (SELECT c_custkey, c_custkey % 10 = 3 AS gone FROM customer),
orders_g AS (SELECT o_orderkey, coalesce(c.gone, FALSE) OR o_orderkey % 50 = 7 AS gone FROM orders LEFT JOIN customer_g c ON c_custkey = o_custkey),
lineitem_g AS (SELECT l_orderkey, coalesce(o.gone, FALSE) AS gone FROM lineitem LEFT JOIN orders_g o ON o_orderkey = l_orderkey),
mention_g AS (SELECT source_id, coalesce(o.gone, FALSE) AS gone FROM mention LEFT JOIN orders_g o ON o_orderkey = source_id)
{' UNION ALL '.join(_COUNTED.format(t=t, k=k) for t, k in (('customer', 'c_custkey'), ('orders', 'o_orderkey'), ('lineitem', 'l_orderkey'), ('mention', 'source_id')))}""")
def cascaded_deletes(t: Tables) -> DataFrame:
    """Customers and orders that go, with the orders, lines and mentions that refer to them: what is left and what went."""
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "mention": ["entity_type", "source_id", "chunk_index"]}
    references = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("mention", "source_id", "orders", "o_orderkey")]
    start = {"customer": t.customer.filter("c_custkey % 10 = 3"), "orders": t.orders.filter("o_orderkey % 50 = 7")}
    done = sinks.cascade({name: getattr(t, name) for name in keys}, keys, references, start)
    counted = []
    for name, rows in done.items():
        key = F.col({"mention": "source_id"}.get(name, keys[name][0]))
        kept, gone = (df.agg(F.count("*").alias(n), F.coalesce(F.sum(key), F.lit(0)).cast("long").alias(f"{n}_sum")) for df, n in zip(rows, ("kept", "deleted"), strict=True))
        counted.append(kept.crossJoin(gone).select(F.lit(name).alias("table_name"), "kept", "deleted", "kept_sum", "deleted_sum"))  # a row each
    return reduce(DataFrame.unionByName, counted)
