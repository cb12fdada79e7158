"""Transaction tagging: columns found by hints, vendors, memory, precedence of tags, ordered rules, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.measures import cosine
from tallyspark.functions.text import contains_any, null_if_blank, slug
from tallyspark.functions.vendor import personal_tag
from tallyspark.operators.order import keep_last

REVIEW = "Review with Client"


def find_column(columns: list[str], hints: list[str]) -> str | None:
    """The column that equals a hint (in the hints' order, any case), else one that holds a hint or lies in one."""
    low = {c.strip().lower().replace("\n", " "): c for c in reversed(columns)}
    for h in hints:
        if h.lower() in low:
            return low[h.lower()]
    return next((c for h in hints for k, c in reversed(list(low.items())) if h.lower() in k or k in h.lower()), None)


def find_columns(columns: list[str], hints: dict[str, list[str]], optional: tuple[str, ...] = ()) -> dict[str, str]:
    """A column for each name; those that can't be found are an error, but for the optional ones."""
    found = {n: find_column(columns, h) for n, h in hints.items()}
    missing = [n for n, c in found.items() if c is None and n not in optional]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return {n: c for n, c in found.items() if c is not None}


def map_columns(df: DataFrame, mapping: list[tuple[str, str]], targets: list[str], keep: list[str] | None = None) -> DataFrame:
    """The target columns of a (header, target) list; headers match without case, line breaks and outer spaces.
    Of several headers of one target the last that isn't empty counts; a target without header is null."""
    plain = lambda c: " ".join(c.split()).lower()
    here = {plain(c): c for c in df.columns}
    out = []
    for t in targets:
        sources = [here[plain(h)] for h, x in mapping if x == t and plain(h) in here]
        out.append((F.coalesce(*[null_if_blank(F.col(f"`{c}`")) for c in reversed(sources)]) if sources else F.lit(None).cast("string")).alias(t))
    return df.select(*(keep or []), *out)


def infer_description(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """A missing description is the first text of over 10 characters that names a security."""
    named = lambda c: F.when((F.length(c) > 10) & F.upper(c).rlike("INC|CORP|STOCK|CUSIP"), F.col(c))
    return df.withColumn(target, F.coalesce(F.col(target), *[named(c) for c in columns]))


def signed_amount(debit: Column, credit: Column) -> Column:
    return F.coalesce(credit, F.lit(0)) - F.coalesce(debit, F.lit(0))


def mark_expenses(df: DataFrame, amount: str, by: list[str] | None = None) -> DataFrame:
    """is_expense: negative amounts; where a file has none and all are positive, every positive one."""
    keys = by or []
    facts = df.groupBy(*keys).agg(F.max((F.col(amount) < 0).cast("int")).alias("_neg"), F.min((F.col(amount) > 0).cast("int")).alias("_pos"))
    joined = df.join(facts, keys) if keys else df.crossJoin(F.broadcast(facts))
    return joined.withColumn("is_expense", F.when(F.col("_neg") == 1, F.col(amount) < 0).otherwise((F.col("_pos") == 1) & (F.col(amount) > 0))).drop("_neg", "_pos")


def vendor_table(df: DataFrame, vendor: str, amount: str, order: str) -> DataFrame:
    """Vendors with count and sum, in the order in which they are first seen."""
    return df.groupBy(vendor).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"), F.min(order).alias("first_seen"))


def prefill(vendors: DataFrame, memory: DataFrame, vendor: str, order: list[str]) -> DataFrame:
    """tag, subcategory and badge: the last memory of the vendor, else its personal rule, else blank."""
    last = keep_last(memory, [vendor], order).select(vendor, F.col("tag").alias("_tag"), F.col("subcategory").alias("_sub"))
    auto = F.nullif(personal_tag(F.col(vendor)), F.lit(""))
    out = vendors.join(last, vendor, "left")
    badge = F.when(F.col("_tag").isNotNull(), "memory").when(auto.isNotNull(), "auto").otherwise("")
    return out.withColumn("tag", F.coalesce("_tag", auto, F.lit(""))).withColumn("subcategory", F.coalesce("_sub", F.lit(""))).withColumn("badge", badge).drop("_tag", "_sub")


def pending(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("tag", F.lit("")) == "")


def known(vendors: DataFrame, memory: DataFrame, vendor: str) -> DataFrame:
    return vendors.join(memory, vendor, "left_semi")


def unknown(vendors: DataFrame, memory: DataFrame, vendor: str) -> DataFrame:
    return vendors.join(memory, vendor, "left_anti")


def apply_tags(rows: DataFrame, prepared: DataFrame, memory: DataFrame, model: DataFrame, vendor: str, amount: str, threshold: float = 0.75) -> DataFrame:
    """tag, subcategory, tag_source, confidence and reason of each row.

    Not negative: blank and 'income'. A prepared vendor has confidence 1 and is 'lookup' if tag and subcategory
    are those of the memory, else 'preparer'. Else the model's answer is 'claude' from the threshold on and
    'flagged' below; without an answer the tag is Review with Client, flagged, with confidence 0."""
    p = prepared.select(vendor, F.col("tag").alias("_pt"), F.col("subcategory").alias("_ps"))
    m = memory.select(vendor, F.col("tag").alias("_mt"), F.col("subcategory").alias("_ms"))
    a = model.select(vendor, F.col("tag").alias("_at"), F.col("subcategory").alias("_as"), F.col("confidence").alias("_ac"), F.col("reason").alias("_ar"))
    x = rows.join(p, vendor, "left").join(m, vendor, "left").join(a, vendor, "left")
    income = ~F.coalesce(F.col(amount) < 0, F.lit(False))
    ready = F.coalesce(F.col("_pt"), F.lit("")) != ""
    same = (F.col("_pt") == F.coalesce("_mt", F.lit(""))) & (F.coalesce("_ps", F.lit("")) == F.coalesce("_ms", F.lit("")))
    pick = lambda a_, b, c: F.when(income, a_).when(ready, b).otherwise(c)
    source = F.when(F.col("_ac") >= threshold, "claude").otherwise("flagged")
    out = x.withColumn("tag", pick(F.lit(""), F.col("_pt"), F.coalesce("_at", F.lit(REVIEW))))
    out = out.withColumn("subcategory", pick(F.lit(""), F.coalesce("_ps", F.lit("")), F.coalesce("_as", F.lit(""))))
    out = out.withColumn("tag_source", pick(F.lit("income"), F.when(same, "lookup").otherwise("preparer"), source))
    out = out.withColumn("confidence", pick(F.lit(None).cast("double"), F.lit(1.0), F.coalesce("_ac", F.lit(0.0))))
    return out.withColumn("reason", pick(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("_ar"))).drop("_pt", "_ps", "_mt", "_ms", "_at", "_as", "_ac", "_ar")


def overlay_edits(rows: DataFrame, edits: DataFrame, vendor: str) -> DataFrame:
    """Edited vendors take the edit; 'rwc' if it still says to review, else 'preparer'; confidence and reason go."""
    e = edits.select(vendor, F.col("tag").alias("_t"), F.col("subcategory").alias("_s"), F.lit(True).alias("_e"))
    x = rows.join(e, vendor, "left")
    hit = F.coalesce("_e", F.lit(False)) & (F.col("tag_source") != "income")
    new = {"tag": F.col("_t"), "subcategory": F.col("_s"), "tag_source": F.when(F.col("_t") == REVIEW, "rwc").otherwise("preparer"), "confidence": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")}
    return x.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def flagged_vendors(rows: DataFrame, vendor: str, order: str, amount: str) -> DataFrame:
    f = rows.where("tag_source = 'flagged'").groupBy(vendor)
    return f.agg(F.min_by("tag", order).alias("tag"), F.min_by("subcategory", order).alias("subcategory"), F.avg("confidence").alias("confidence"), F.min_by("reason", order).alias("reason"), F.min_by(amount, order).alias("amount"))


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag_source").agg(F.count("*").alias("n"))


def hit_rate(rows: DataFrame, vendor: str, order: str) -> DataFrame:
    """vendors without income, those of them whose first source is the memory, and the share in percent."""
    first = rows.where("tag_source <> 'income'").groupBy(vendor).agg(F.min_by("tag_source", order).alias("s"))
    return first.agg(F.count("*").alias("vendors"), F.count_if(F.col("s") == "lookup").alias("hits")).withColumn("percent", F.round(100 * F.col("hits") / F.col("vendors"), 0))


def split_outputs(rows: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """The named outputs of a tagged file."""
    return {"Tagged": rows, "Personal": rows.where(F.col("tag").startswith("Personal -")), "Review with Client": rows.where("tag_source = 'rwc'"), "Summary": summary}


def learned(rows: DataFrame, client: str, vendor: str, date: Column, order: list[str]) -> DataFrame:
    """What a run adds to the memory: vendors tagged by the model or the preparer, each with the last tag in `order`."""
    good = rows.where(F.col("tag_source").isin("claude", "preparer") & (F.col("tag") != REVIEW))
    last = keep_last(good.withColumns({"client_id": F.lit(client), "vendor_name": F.col(vendor)}), ["client_id", "vendor_name"], order)
    return last.select("client_id", "vendor_name", "tag", "subcategory", F.col("tag_source").alias("source"), date.alias("date_tagged"))


def vocabulary(*parts: DataFrame, column: str = "tag") -> DataFrame:
    """The distinct union of vocabularies (tag, pos) without blanks, each with the first part that has it and its first
    place there: (tag, part, pos), to be ordered by part and pos."""
    out = None
    for k, p in enumerate(parts):
        rows = p.select(F.trim(column).alias(column), F.struct(F.lit(k).alias("part"), F.col("pos").cast("bigint").alias("pos")).alias("_at")).where(F.trim(column) != "")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(column).agg(F.min("_at").alias("_at")).select(column, "_at.part", "_at.pos")


def keyword_category(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first category of which the text has a whole word, or null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(rules):
        out = F.when(contains_any(text, words, whole=True), name).otherwise(out)
    return out


def nearest_anchor(rows: DataFrame, anchors: DataFrame, key: str, vector: str, threshold: float, review: float) -> DataFrame:
    """category, score and match ('match', 'near', 'none') of the anchor (category, vec) with the largest cosine.

    Anchors are a fixed list and go to every executor; the best is taken per row without a shuffle of pairs."""
    one = anchors.agg(F.sort_array(F.collect_list(F.struct("category", "vec"))).alias("_anchors"))
    scored = F.transform("_anchors", lambda a: F.struct(cosine(F.col(vector), a["vec"]).alias("score"), a["category"].alias("category")))
    best = F.array_max(scored)
    out = rows.crossJoin(F.broadcast(one)).withColumn("_b", best)
    kind = F.when(F.col("_b.score") >= threshold, "match").when(F.col("_b.score") >= review, "near").otherwise("none")
    return out.select(key, F.col("_b.category").alias("category"), F.round("_b.score", 2).alias("score"), kind.alias("match"))


def match_rules(rows: DataFrame, rules: DataFrame, key: list[str], text: str) -> DataFrame:
    """Rows with the outputs of the rule of the least priority that fits their lower-cased text.

    rules: priority, kind ('prefix', 'equals', 'contains'), pattern, and outputs; a fixed small table."""
    low = F.lower(F.trim(text))
    outs = [c for c in rules.columns if c not in ("priority", "kind", "pattern")]
    table = rules.agg(F.sort_array(F.collect_list(F.struct("priority", "kind", "pattern", *outs))).alias("_rules"))

    def fit(r: Column) -> Column:
        return F.when(r["kind"] == "prefix", low.startswith(r["pattern"])).when(r["kind"] == "equals", low == r["pattern"]).otherwise(low.contains(r["pattern"]))

    hit = F.get(F.filter("_rules", fit), F.lit(0))
    return rows.crossJoin(F.broadcast(table)).withColumn("_r", hit).select(*rows.columns, *[F.col("_r")[c].alias(c) for c in outs])


def detect_format(docs: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """The format of each text: of the rules (format, priority, keywords) all of whose keywords it has, the one of
    the least priority; 'unknown' if none fits, 'no text' if there is none."""
    table = rules.agg(F.sort_array(F.collect_list(F.struct("priority", "format", "keywords"))).alias("_rules"))
    hit = F.get(F.filter("_rules", lambda r: F.forall(r["keywords"], lambda k: F.lower(text).contains(F.lower(k)))), F.lit(0))["format"]
    return docs.crossJoin(F.broadcast(table)).select(key, F.when(F.coalesce(F.trim(text), F.lit("")) == "", "no text").otherwise(F.coalesce(hit, F.lit("unknown"))).alias("format"))


def best_match(rows: DataFrame, library: DataFrame, key: str, variant: str | None, role: str, order: list[str]) -> DataFrame:
    """The library's ref (key, role, variant, ref) for a row's key in a role: of the exact variant, else the first in `order`
    that is for ANY or no variant. Without `variant` (an image) the first of the key counts, whatever its own. A blank ref is null."""
    at = F.struct(*order)
    lib = library.where(F.col("role") == role).select(F.col(key).alias("_k"), F.coalesce(variant, F.lit("")).alias("_v") if variant else F.lit("").alias("_v"), at.alias("_at"), F.nullif(F.trim("ref"), F.lit("")).alias("_ref"))
    first = lib.groupBy("_k", "_v").agg(F.min_by(F.struct("_ref"), "_at").alias("_r"), F.min("_at").alias("_at"))
    own = first.select("_k", "_v", F.col("_r._ref").alias("_own"), F.lit(True).alias("_has"))
    others = lib.where(F.col("_v").isin("ANY", "") & F.col("_ref").isNotNull()).groupBy("_k").agg(F.min_by("_ref", "_at").alias("_any"))
    wanted = F.col(variant) if variant else F.lit("")
    out = rows.join(own, (F.col(key) == own["_k"]) & (wanted == own["_v"]), "left").drop("_k", "_v").join(others, F.col(key) == others["_k"], "left")
    return out.select(*rows.columns, F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_any") if variant else F.lit(None)).alias("ref"))


def sparse_override(rows: DataFrame, overrides: DataFrame, key: str, name: str) -> DataFrame:
    """The override's value, or the key itself where it is blank or absent."""
    o = overrides.select(key, F.col(name).alias("_o"))
    return rows.join(o, key, "left").withColumn(name, F.coalesce(F.nullif(F.trim("_o"), F.lit("")), F.col(key).cast("string"))).drop("_o")


#: Fixed values of the debit and credit test, credits first.
CREDITS = ["Incoming Wire Transfer", "Incoming Wire", "Insufficient Funds", "ACH Electronic Credit", "Deposit", "Transfer From", "Direct Dep", "Wire Transfer Credit", "Zelle Credit", "Other Credit", "Refund", "Interest Payment", "Purchase Return"]
DEBITS = ["Wire Transfer Fee", "Incoming Wire Fee", "Debit Card Purchase", "ACH Electronic Debit", "Check #", "Check#", "Recurring Card Purchase", "Bill Payment", "Online Payment", "Zelle Payment", "Zelle Debit", "Wire Transfer Debit", "ATM Withdrawal", "Cash Withdrawal", "Debit Pay", "Citibank Online Pmt", "Transfer To", "Transter to", "Outgoing Domestic", "Domestic Funds Transfer", "Service Fee", "Mobile Purchase", "Purchase"]


def classify_debit_credit(text: Column, credits: list[str] = CREDITS, debits: list[str] = DEBITS) -> Column:
    """credit, debit or unknown; credit words are tried first."""
    return F.when(contains_any(text, credits), "credit").when(contains_any(text, debits), "debit").otherwise("unknown")


def derived_measures(readings: DataFrame, profiles: DataFrame) -> DataFrame:
    """bmi, bmr and whr rows of clients' same-date readings (client_id, date, metric, value, recorded_at); of
    repeated readings the last recorded counts. profiles: client_id, gender (male or female; others have no bmr), dob, height_cm."""
    from tallyspark.functions.measures import age_years, bmi, bmr, whr

    one = readings.groupBy("client_id", "date", "metric").agg(F.max_by("value", "recorded_at").alias("value"))
    wide = one.groupBy("client_id", "date").pivot("metric", ["weight", "height", "waist", "hips"]).agg(F.first("value")).join(profiles, "client_id", "left")
    height = F.coalesce("height", "height_cm")
    male = F.when(F.lower("gender") == "male", True).when(F.lower("gender") == "female", False)
    made = wide.select("client_id", "date", bmi(F.col("weight"), F.col("height")).alias("bmi"), bmr(F.col("weight"), height, age_years(F.col("dob"), F.col("date")), male).alias("bmr"), whr(F.col("waist"), F.col("hips")).alias("whr"))
    return made.unpivot(["client_id", "date"], ["bmi", "bmr", "whr"], "metric", "value").where("value is not null")


def with_overrides(df: DataFrame, overrides: list[tuple[Column, str]], name: str, otherwise: Column) -> DataFrame:
    """`name`: the value of the first override whose condition holds on the row, before any rule, else `otherwise`."""
    out = otherwise
    for condition, value in reversed(overrides):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return df.withColumn(name, out)


def match_audit(keyword: Column, cosine_label: Column, score: Column) -> Column:
    """How a category was found: 'keyword', 'cosine (0.72)' or null."""
    return F.when(keyword.isNotNull(), "keyword").when(cosine_label.isNotNull(), F.concat(F.lit("cosine ("), F.round(score, 2).cast("string"), F.lit(")")))


def category_totals(df: DataFrame, category: str, near: str, amount: str) -> DataFrame:
    """n, total and near misses of each category: rows that have it, their sum, and rows that only come near it."""
    hits = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
    misses = df.where(F.col(category).isNull() & F.col(near).isNotNull()).groupBy(F.col(near).alias("category")).agg(F.count("*").alias("near"))
    return hits.join(misses, "category", "full_outer").select("category", F.coalesce("n", F.lit(0)).alias("n"), "total", F.coalesce("near", F.lit(0)).alias("near"))


def slug_ids(df: DataFrame, name: str, order: list[str], out: str = "id") -> DataFrame:
    """An id from each name; of names with the same id the first keeps it and the next get _2, _3 and so on."""
    s = slug(F.col(name))
    k = F.row_number().over(Window.partitionBy("_slug").orderBy(*order))
    return df.withColumn("_slug", s).withColumn("_k", k).withColumn(out, F.when(F.col("_k") == 1, F.col("_slug")).otherwise(F.concat_ws("_", "_slug", F.col("_k").cast("string")))).drop("_slug", "_k")
