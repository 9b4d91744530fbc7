"""Product graph neighbours and customer category affinity, as joins.

Graph mapping on the TPC-H-style tables: Product = part (name, price =
retail price, popularity = number of order lines), Category = p_type,
COMPLEMENTARY_TO = another part on a common order, SIMILAR_TO = another part
of the same brand and size band (size // 10), PURCHASED = order lines of the
customer's orders.

Neighbour lists keep the three smallest distinct names (the reference leaves
the order open; ours: name ascending). They are built without enumerating
pairs: a group (an order, a brand/size band) contributes only its four
smallest distinct names with their part counts; each member takes those minus
its own name when it is the only part with that name, and members reduce their
candidates with a partial top-3 before the shuffle. Work is linear in the
order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 3


def products(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    pop = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("popularity"))
    return part.join(pop, "p_partkey", "left").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_retailprice").alias("price"), F.coalesce(F.col("popularity"), F.lit(0)).alias("popularity"),
        F.col("p_type").alias("category"), "p_brand", "p_size")


def _group_neighbours(members: DataFrame, group: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """members: (group..., product_id, product_name), one row per membership.
    Returns (product_id, name) candidate rows: for each member, the k smallest
    distinct names of *other* parts in each of its groups."""
    names = members.groupBy(*group, "product_name").agg(F.count_distinct("product_id").alias("n_parts"))
    w = Window.partitionBy(*group).orderBy("product_name")
    top = names.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k + 1).drop("__r")
    m = members.select(*group, "product_id", F.col("product_name").alias("__own"))
    c = m.join(top, on=group, how="inner")
    # a name is available to the member unless the member is its only part
    c = c.where((F.col("product_name") != F.col("__own")) | (F.col("n_parts") > 1))
    wc = Window.partitionBy(*group, "product_id").orderBy("product_name")
    c = c.withColumn("__r", F.row_number().over(wc)).where(F.col("__r") <= k)
    return c.select("product_id", F.col("product_name").alias("name"))


def _top_names(cands: DataFrame, out: str, k: int = NEIGHBOURS) -> DataFrame:
    d = cands.distinct()
    w = Window.partitionBy("product_id").orderBy("name")
    top = d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.groupBy("product_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__r", "name"))), lambda x: x["name"]).alias(out))


def complementary(lineitem: DataFrame, part: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(product_id, complementary): names of other parts sharing an order.

    ``of`` (product_id) restricts the work to the orders of those products."""
    li = lineitem.select("l_orderkey", F.col("l_partkey").alias("product_id")).distinct()
    if of is not None:
        orders = li.join(of.select("product_id").distinct(), "product_id", "left_semi").select("l_orderkey").distinct()
        li = li.join(orders, "l_orderkey", "left_semi")
    members = li.join(part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")),
                      "product_id", "inner")
    cands = _group_neighbours(members, ["l_orderkey"])
    if of is not None:
        cands = cands.join(of.select("product_id").distinct(), "product_id", "left_semi")
    return _top_names(cands, "complementary")


def similar(part: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(product_id, similar): names of other parts of the same brand and size band."""
    members = part.select(F.col("p_brand"), F.floor(F.col("p_size") / 10).alias("size_band"),
                          F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    cands = _group_neighbours(members, ["p_brand", "size_band"])
    if of is not None:
        cands = cands.join(of.select("product_id").distinct(), "product_id", "left_semi")
    return _top_names(cands, "similar")


def product_graph(part: DataFrame, lineitem: DataFrame, max_results: int = 5) -> DataFrame:
    """Per category: the ``max_results`` most popular products (ties: name, id)
    with up to three complementary and three similar product names (empty list
    when none). Neighbours are computed only for the selected products."""
    from shoptide.session import materialize

    p = products(part, lineitem)
    w = Window.partitionBy("category").orderBy(F.col("popularity").desc(), F.col("product_name"), F.col("product_id"))
    # the selected products feed three branches; write them once (max_results per category)
    top = materialize(p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_results), "top-products")
    comp = complementary(lineitem, part, of=top)
    sim = similar(part, of=top)
    empty = F.array().cast("array<string>")
    return top.join(comp, "product_id", "left").join(sim, "product_id", "left").select(
        "category", "product_id", "product_name", "price", "popularity",
        F.coalesce(F.col("complementary"), empty).alias("complementary"),
        F.coalesce(F.col("similar"), empty).alias("similar"), "rank")


def customer_affinity(orders: DataFrame, lineitem: DataFrame, part: DataFrame, max_categories: int = 5) -> DataFrame:
    """Per customer: purchase count and total price per category over all order
    lines, the top ``max_categories`` by count (ties: category), plus
    top_category and total_categories (the number of rows returned)."""
    li = lineitem.select("l_orderkey", "l_partkey")
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id"))
    p = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"),
                    F.col("p_retailprice").alias("price"))
    pur = li.join(o, "l_orderkey").join(p, "l_partkey")
    agg = pur.groupBy("customer_id", "category").agg(
        F.count(F.lit(1)).alias("purchase_count"), F.sum("price").alias("total_spent"))
    w = Window.partitionBy("customer_id").orderBy(F.col("purchase_count").desc(), F.col("category"))
    top = agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_categories)
    wc = Window.partitionBy("customer_id")
    return top.select("customer_id", "category", "purchase_count", "total_spent", "rank",
                      F.min_by("category", F.col("rank")).over(wc).alias("top_category"),
                      F.count(F.lit(1)).over(wc).alias("total_categories"))


def empty_lookup(keys: DataFrame, found: DataFrame, key: str, list_col: str) -> DataFrame:
    """Requested keys with their list, an empty list where nothing was found."""
    j = keys.join(found, key, "left")
    return j.withColumn(list_col, F.coalesce(F.col(list_col), F.array().cast(found.schema[list_col].dataType)))
