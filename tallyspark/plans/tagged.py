"""Queries of tagging: vendors, memory, precedence, rules, keywords and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.vendor import vendor_name
from tallyspark.operators import tagging as t
from tallyspark.plans.common import dbl, money, query, table


def _rows(spark, sf):
    """Line items as transactions of the part's brand; every third is an income."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    sign = F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(-1)
    return li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("p_brand").alias("vendor"), (money("l_extendedprice") * sign).cast("decimal(18,2)").alias("amount"))


ROWS = "rows AS (SELECT l_orderkey * 100 + l_linenumber AS seq, p_brand AS vendor, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE -1 END AS DECIMAL(18,2)) AS amount, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS b FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _sides(spark, sf):
    """Memory of brands divisible by 3, prepared tags of those divisible by 2, model answers of those by 5."""
    v = table(spark, sf, "part").select(F.col("p_brand").alias("vendor")).distinct().withColumn("b", F.regexp_extract("vendor", r"(\d+)", 1).cast("int"))
    memory = v.where("b % 3 = 0").select("vendor", F.lit("Supplies").alias("tag"), F.lit("").alias("subcategory"), F.col("b").alias("seq"))
    prepared = v.where("b % 2 = 0").select("vendor", F.lit("Supplies").alias("tag"), F.when(F.col("b") % 4 == 0, "Paper").otherwise("").alias("subcategory"))
    model = v.where("b % 5 = 0").select("vendor", F.lit("Tools").alias("tag"), F.lit("Hand").alias("subcategory"), F.when(F.col("b") % 10 == 5, 0.9).otherwise(0.2).alias("confidence"), F.lit("why").alias("reason"))
    return memory, prepared, model


APPLIED = f"""WITH {ROWS}, a AS (SELECT *, CASE WHEN NOT amount < 0 THEN '' WHEN b % 2 = 0 THEN 'Supplies' WHEN b % 5 = 0 THEN 'Tools' ELSE 'Review with Client' END AS tag,
CASE WHEN NOT amount < 0 THEN '' WHEN b % 2 = 0 THEN CASE WHEN b % 4 = 0 THEN 'Paper' ELSE '' END WHEN b % 5 = 0 THEN 'Hand' ELSE '' END AS subcategory,
CASE WHEN NOT amount < 0 THEN 'income' WHEN b % 2 = 0 THEN CASE WHEN b % 3 = 0 AND b % 4 <> 0 THEN 'lookup' ELSE 'preparer' END WHEN b % 10 = 5 THEN 'claude' ELSE 'flagged' END AS tag_source,
CASE WHEN NOT amount < 0 THEN NULL WHEN b % 2 = 0 THEN 1.0 WHEN b % 10 = 5 THEN 0.9 WHEN b % 5 = 0 THEN 0.2 ELSE 0.0 END AS confidence FROM rows)"""


def _applied(spark, sf):
    memory, prepared, model = _sides(spark, sf)
    return t.apply_tags(_rows(spark, sf), prepared, memory, model, "vendor", "amount")


@query(APPLIED + " SELECT seq, vendor, tag, subcategory, tag_source, confidence FROM a")
def tag_apply(spark, sf):
    return _applied(spark, sf).select("seq", "vendor", "tag", "subcategory", "tag_source", "confidence")


@query(APPLIED + " SELECT tag_source, count(*) AS n FROM a GROUP BY 1")
def tag_sources(spark, sf):
    return t.source_counts(_applied(spark, sf))


@query(APPLIED + ", v AS (SELECT vendor, arg_min(tag_source, seq) AS s FROM a WHERE tag_source <> 'income' GROUP BY 1) SELECT count(*) AS vendors, count(*) FILTER (s = 'lookup') AS hits, round(100.0 * count(*) FILTER (s = 'lookup') / count(*), 0) AS percent FROM v")
def hit_rate(spark, sf):
    return t.hit_rate(_applied(spark, sf), "vendor", "seq")


@query(APPLIED + " SELECT vendor, min(tag) AS tag, round(avg(confidence), 6) AS confidence, CAST(arg_min(amount, seq) AS DOUBLE) AS amount FROM a WHERE tag_source = 'flagged' GROUP BY 1")
def flagged_vendors(spark, sf):
    return t.flagged_vendors(_applied(spark, sf), "vendor", "seq", "amount").select("vendor", "tag", F.round("confidence", 6).alias("confidence"), dbl("amount").alias("amount"))


@query(APPLIED + """, e AS (SELECT *, b % 7 = 0 AND tag_source <> 'income' AS hit, CASE WHEN b % 14 = 0 THEN 'Review with Client' ELSE 'Fuel' END AS et FROM a)
SELECT seq, CASE WHEN hit THEN et ELSE tag END AS tag, CASE WHEN hit THEN CASE WHEN et = 'Review with Client' THEN 'rwc' ELSE 'preparer' END ELSE tag_source END AS tag_source FROM e""")
def overlay_edits(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_brand").alias("vendor")).distinct().withColumn("b", F.regexp_extract("vendor", r"(\d+)", 1).cast("int"))
    edits = v.where("b % 7 = 0").select("vendor", F.when(F.col("b") % 14 == 0, t.REVIEW).otherwise("Fuel").alias("tag"), F.lit("").alias("subcategory"))
    return t.overlay_edits(_applied(spark, sf), edits, "vendor").select("seq", "tag", "tag_source")


@query(f"WITH {ROWS} SELECT vendor, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, min(seq) AS first_seen FROM rows GROUP BY 1")
def vendor_table(spark, sf):
    return t.vendor_table(_rows(spark, sf), "vendor", "amount", "seq").withColumn("amount", dbl("amount"))


@query("""WITH v AS (SELECT DISTINCT p_brand AS vendor, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS b FROM part)
SELECT vendor, CASE WHEN b % 3 = 0 THEN 'Supplies' ELSE '' END AS tag, CASE WHEN b % 3 = 0 THEN 'memory' ELSE '' END AS badge FROM v""")
def tag_precedence(spark, sf):
    memory, _, _ = _sides(spark, sf)
    doubled = memory.unionByName(memory.withColumn("tag", F.lit("Old")).withColumn("seq", F.col("seq") - 1000))
    v = table(spark, sf, "part").select(F.col("p_brand").alias("vendor")).distinct()
    return t.prefill(v, doubled, "vendor", ["seq"]).select("vendor", "tag", "badge")


@query("""SELECT c_custkey, true AS known FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def known_unknown(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    m = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.known(c, m, "c_custkey").withColumn("known", F.lit(True)).unionByName(t.unknown(c, m, "c_custkey").withColumn("known", F.lit(False)))


@query(f"WITH {ROWS}, f AS (SELECT vendor, bool_or(amount < 0) AS neg, bool_and(amount > 0) AS pos FROM rows GROUP BY 1) SELECT seq, CASE WHEN neg THEN amount < 0 ELSE pos AND amount > 0 END AS is_expense FROM rows JOIN f USING (vendor)")
def expenses(spark, sf):
    return t.mark_expenses(_rows(spark, sf), "amount", ["vendor"]).select("seq", "is_expense")


@query("""SELECT p_partkey, upper(p_name) AS vendor FROM part""")
def vendor_extract(spark, sf):
    """Part names wrapped as bank descriptions come out clean."""
    p = table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("n"))
    shapes = F.array(F.concat(F.lit("Card Purchase - "), "n"), F.concat(F.lit("Debit Card Purchase 01/15 12:34 #1234 | "), "n", F.lit(" | Retail")), F.concat(F.lit("SQ *"), "n", F.lit(" 11/21")), F.concat(F.lit("ACH Electronic Debit "), "n"), F.concat("n", F.lit(" 800-956-6310")), F.concat(F.lit("Withdrawal from "), "n", F.lit(" XXXX1234")))
    return p.select("p_partkey", vendor_name(F.get(shapes, (F.col("p_partkey") % 6).cast("int"))).alias("vendor"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(mit license|apache license)($|[^A-Za-z0-9_])') THEN 'permissive' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(gnu|cc by-nc 4.0)($|[^A-Za-z0-9_])') THEN 'restricted' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(the|and)($|[^A-Za-z0-9_])') THEN 'english' END AS category FROM documents""")
def keyword_category(spark, sf):
    rules = [("permissive", ["MIT License", "Apache License"]), ("restricted", ["GNU", "CC BY-NC 4.0"]), ("english", ["the", "and"])]
    return table(spark, sf, "documents").select("doc_id", t.keyword_category(F.col("text"), rules).alias("category"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), a AS (SELECT CAST(label AS VARCHAR) AS category, arg_min(v, vec_id) AS w FROM e GROUP BY 1),
s AS (SELECT vec_id, category, list_cosine_similarity(v, w) AS c FROM e, a), b AS (SELECT vec_id, arg_max(category, c) AS category, max(c) AS c FROM s GROUP BY 1)
SELECT vec_id, category, CASE WHEN c >= 0.55 THEN 'match' WHEN c >= 0.35 THEN 'near' ELSE 'none' END AS match FROM b""")
def nearest_anchor(spark, sf):
    e = table(spark, sf, "embeddings")
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(F.col("label").cast("string").alias("category"), "vec")
    return t.nearest_anchor(e, anchors, "vec_id", "embedding", 0.55, 0.35).select("vec_id", "category", "match")


@query("""WITH p AS (SELECT p_partkey, lower(p_type || ':' || p_brand) AS c, p_type, CAST(p_retailprice AS DECIMAL(18,2)) AS a FROM part),
r AS (SELECT *, CASE WHEN c = 'economy:brand#1' THEN 'FIRST' WHEN starts_with(c, 'economy:') THEN 'ECONOMY' WHEN contains(c, 'brand#2') THEN 'TWOS' ELSE 'OTHER' END AS section FROM p)
SELECT section, p_type AS line, CAST(sum(a) AS DOUBLE) AS total, count(*) AS n FROM r GROUP BY ALL""")
def ledger_rules(spark, sf):
    from tallyspark.operators.summary import three_levels

    rules = spark.createDataFrame([(1, "equals", "economy:brand#1", "FIRST"), (2, "prefix", "economy:", "ECONOMY"), (3, "contains", "brand#2", "TWOS")], "priority int, kind string, pattern string, section string")
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_type", F.lit(":"), "p_brand").alias("category"), "p_type", money("p_retailprice").alias("a"))
    x = t.match_rules(p, rules, ["p_partkey"], "category").withColumn("section", F.coalesce("section", F.lit("OTHER"))).withColumn("sub", F.lit(None).cast("string"))
    return three_levels(x, "section", "sub", F.col("p_type").alias("line"), "a").select("section", "line", dbl("total").alias("total"), "n")


@query("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'male0' ELSE 'any0' END WHEN 1 THEN CASE WHEN n_nationkey % 2 = 1 THEN 'blank1' END WHEN 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'male2' END WHEN 3 THEN 'any3' END AS icon,
CASE WHEN n_regionkey IN (0, 4) THEN 'image' || n_regionkey END AS image FROM nation""")
def fallback_match(spark, sf):
    """Icons by variant, with what is for any (the first of two) where there is none; an exact one without a ref gives none. Images
    whatever their variant; the first of a key counts."""
    k = F.col("r_regionkey")
    entries = [(0, "icon", "male", "male0"), (0, "icon", "ANY", "any0"), (0, "icon", "", "late0"), (0, "image", "male", "image0"), (0, "image", "ANY", "late0"), (1, "icon", "male", " "), (1, "icon", "", "blank1"), (2, "icon", "male", "male2"), (3, "icon", "ANY", ""), (3, "icon", "", "any3"), (3, "image", "ANY", ""), (3, "image", "", "late3"), (4, "image", "female", "image4")]
    rule = F.explode(F.filter(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(i).alias("place"), F.lit(a).alias("role"), F.lit(v).alias("variant"), F.lit(x).alias("ref")) for i, (r, a, v, x) in enumerate(entries)]), lambda e: e["r"] == k))
    lib = table(spark, sf, "region").select(k.alias("n_regionkey"), rule.alias("e")).select("n_regionkey", "e.place", "e.role", "e.variant", "e.ref")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "male").otherwise("female").alias("variant"))
    icons = t.best_match(rows, lib, "n_regionkey", "variant", "icon", ["place"]).withColumnRenamed("ref", "icon")
    return t.best_match(icons, lib, "n_regionkey", None, "image", ["place"]).select("n_nationkey", "icon", F.col("ref").alias("image"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 1 THEN 'group' || CAST(n_regionkey AS VARCHAR) ELSE CAST(n_regionkey AS VARCHAR) END AS asset FROM nation""")
def sparse_override(spark, sf):
    over = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.when(F.col("r_regionkey") % 2 == 1, F.concat(F.lit("group"), F.col("r_regionkey").cast("string"))).otherwise(" ").alias("asset"))
    return t.sparse_override(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), over, "n_regionkey", "asset").select("n_nationkey", "asset")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 2, 8) THEN 'credit' WHEN o_orderkey % 9 IN (1, 4, 5) THEN 'debit' ELSE 'unknown' END AS kind FROM orders""")
def debit_credit(spark, sf):
    """Credits are tried first; misread words, parts of words and texts of neither kind."""
    texts = F.array(*map(F.lit, ["Mobile purchase return X", "ZELLE PAYMENT to X", "Returned insufficient funds - Check #12", "Something else", "TRANSTER TO savings", "x citibank online pmt 12", "Online Pmt", "", "Incoming wire fee"]))
    o = table(spark, sf, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % 9).cast("int")).alias("d"))
    return o.select("o_orderkey", t.classify_debit_credit(F.col("d")).alias("kind"))


@query("""WITH u AS (SELECT p_brand AS tag, 0 AS part, p_partkey AS pos FROM part UNION ALL SELECT c_mktsegment, 1, c_custkey FROM customer UNION ALL SELECT p_brand, 2, p_partkey FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY part, pos) AS n FROM u) SELECT tag, part, pos FROM r WHERE n = 1""")
def vocabulary(spark, sf):
    """Brands, segments and the brands again with far larger places; blanks go and spaces outside don't count."""
    a = table(spark, sf, "part").select(F.concat(F.lit(" "), "p_brand").alias("tag"), F.col("p_partkey").alias("pos"))
    b = table(spark, sf, "customer").select(F.explode(F.array(F.col("c_mktsegment"), F.lit("  "))).alias("tag"), F.col("c_custkey").alias("pos"))
    return t.vocabulary(a, b, a.withColumn("pos", F.col("pos") + 5_000_000_000))
