"""Catalogue views: search match, quotes, gallery, intake, tag parsing
(K4, K5, W2, H4-H6, F12-F18, F20, P5f, P6f, S5, U1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions.text import CATEGORIES, clean_number, clean_text, format_money, search_tokens, text_runs
from shopfloor.sources.tables import stage

# Fixed values that must equal the reference: list-price multipliers for
# standard / VIP / clearance quotes, the default caption price, and the
# stock-badge labels with their thresholds (>= 3 in stock, > 0 low).
STANDARD_X, VIP_X, CLEARANCE_X = 1.8, 1.5, 1.2
DEFAULT_PRICE = 1500
BADGE_IN, BADGE_LOW, BADGE_OUT = "In Stock", "Low Stock", "SOLD OUT"


# ------------------------------------------------------------------ search
#: Characters of an index gram, and of the part of a token that is looked up; a piece of a run has twice as many.
GRAM, NEEDLE = 3, 64
#: Sets of more tokens than this never go through pairs.
PAIRED = 48


def _runs(text: Column) -> Column:
    """Whitespace-free runs of the lower-cased text.  A search token has no
    whitespace, so it is a substring of the text iff it is a substring of
    one run."""
    return text_runs(F.coalesce(text, F.lit("")))


def _pieces(run: Column) -> Column:
    """Overlapping pieces of a run: what has at most NEEDLE characters and lies in the run
    lies in a piece."""
    last = F.ceil((F.length(run) - 2 * NEEDLE) / NEEDLE)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), last)),
                       lambda p: F.substr(run, (p * NEEDLE + 1).cast("int"), F.lit(2 * NEEDLE)))


def _grams(text: str, n: Column) -> Column:
    """Different substrings of length ``n``, which is at most the text's."""
    t = F.col(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, n)))


def _occurrences(pieces: DataFrame, needles: DataFrame) -> DataFrame:
    """(piece, needle) for every needle that is a substring of a piece.

    An inverted index of the pieces' grams; each needle is looked up by its rarest gram
    only, and a needle with a gram that is nowhere is not looked up at all."""
    n = F.least(F.lit(GRAM), F.length("needle"))
    wanted = needles.select("needle", F.explode(_grams("needle", n)).alias("gram"))
    lengths = needles.agg(F.collect_set(n)).scalar()  # of 1, 2 and GRAM
    index = (pieces.select("piece", F.explode(lengths).alias("n")).where(F.col("n") <= F.length("piece"))
             .select("piece", F.explode(_grams("piece", F.col("n"))).alias("gram")))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rarest = (wanted.join(held, "gram", "left").groupBy("needle")
              .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("g"))
              .where(F.col("g.held") > 0).select("needle", F.col("g.gram").alias("gram")))
    return index.join(rarest, "gram").where(F.contains("piece", "needle")).select("piece", "needle")


def matched_tokens(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    """(item_pos, token) for every token that is a substring of an item's lower-cased tags.

    The lookup works on different runs; long ones go by a digest (which has a blank, as no run has)."""
    run = F.col("run")
    key = F.when(F.length(run) <= 2 * NEEDLE, run).otherwise(F.concat(F.lit(" "), F.sha2(run, 256)))
    item_runs = (vault.select(F.col("row_pos").alias("item_pos"), F.explode(F.array_distinct(_runs(F.col("tags")))).alias("run"))
                 .withColumn("key", key))
    runs = stage(item_runs.select("key", "run").distinct(), "runs")
    cut = runs.select("key", F.explode(F.when(F.length(run) <= 2 * NEEDLE, F.array(run)).otherwise(_pieces(run))).alias("piece"))
    looked_up = tokens.select("token", F.substring("token", 1, NEEDLE).alias("needle"))
    occurs = _occurrences(cut.select("piece").distinct(), looked_up.select("needle").distinct())
    found = cut.join(occurs, "piece").select("key", "needle").distinct().join(looked_up, "needle")
    # longer tokens begin with a needle that was found; the rest is compared in the run itself
    whole = F.length("token") <= NEEDLE
    texts = runs.where(F.length(run) > NEEDLE).select(F.col("key").alias("r_key"), "run")
    hits = (found.join(texts, ~whole & (F.col("key") == F.col("r_key")), "left")
            .where(whole | F.contains("run", "token")).select("key", "token"))
    return item_runs.select("item_pos", "key").join(hits, "key").select("item_pos", "token").distinct()


def catalog_match(queries: DataFrame, vault: DataFrame, query_id: str = "query_id",
                  query: str = "query") -> DataFrame:
    """Best catalogue item per search query.

    Score = number of query tokens (repeats count) that are substrings of the
    item's lower-cased tags; keep score > 0; best score wins, ties go to the
    earliest catalogue row (Q18).  Exact, with no theta join and no pair per
    (query row, item row):

    * substrings come out of a gram index over *distinct* pieces of tags (bounded
      by the vocabulary, not the catalogue), ``matched_tokens``;
    * items are collapsed into classes with the same matched-token set
      (named by their earliest row), queries into classes with the same token
      multiset -- the score depends on nothing else;
    * an item that matches one token only is beaten by the earliest item of
      the query's heaviest token, one lookup per token; items that match
      several share a *pair* of tokens, so class pairs meet on token pairs,
      whose lists are short where those of single tokens are long.  With k
      common tokens a class pair meets k(k-1)/2 times, which gives its score;
    * sets of more than ``PAIRED`` tokens, which would make too many pairs, are
      met token by token, with the best score so far as a bound (``_wide``).
    """
    q_tok = (queries.select(F.col(query_id).alias("query_id"), F.explode(search_tokens(F.col(query))).alias("token"))
             .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("weight")))
    # query classes: same (token, weight) multiset
    q_sig = stage(q_tok.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("qsig")), "queries")
    tokens = stage(q_sig.select(F.explode("qsig.token").alias("token")).distinct(), "tokens")
    item_tokens = matched_tokens(vault, tokens)
    # item classes: same matched-token set -> same score against every query
    i_cls = stage(item_tokens.groupBy("item_pos").agg(F.sort_array(F.collect_list("token")).alias("sig"))
                  .groupBy("sig").agg(F.min("item_pos").alias("item_pos")), "items")
    first_item = i_cls.select("item_pos", F.explode("sig").alias("token")).groupBy("token").agg(F.min("item_pos").alias("item_pos"))
    q_cls = q_sig.groupBy("qsig").agg(F.min("query_id").alias("q_cls"))
    singles = (q_cls.select("q_cls", F.inline("qsig")).join(first_item, "token")
               .select("q_cls", "item_pos", F.col("weight").alias("score")))
    few_q, few_i = F.size("qsig") <= PAIRED, F.size("sig") <= PAIRED
    q_pairs = q_cls.where(few_q).select("q_cls", F.inline(_pairs(F.col("qsig"), lambda a, b: F.struct(
        a["token"].alias("a"), b["token"].alias("b"), (a["weight"] + b["weight"]).alias("weight")))))
    i_pairs = i_cls.where(few_i).select("item_pos", F.inline(_pairs(F.col("sig"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    common = (1 + F.sqrt(1 + 8 * F.count(F.lit(1)))) / 2  # tokens that make so many pairs
    several = (q_pairs.join(i_pairs, ["a", "b"]).groupBy("q_cls", "item_pos")
               .agg((F.sum("weight") / (common - 1)).cast("bigint").alias("score")))
    best = _best(singles.unionByName(several))
    if not (q_sig.where(~few_q).isEmpty() and i_cls.where(~few_i).isEmpty()):
        best = stage(best, "best")
        best = _best(best.unionByName(_wide(q_cls, i_cls, best)))
    per_query = q_sig.join(q_cls, "qsig").join(best, "q_cls").select("query_id", "item_pos", "score")
    return per_query.join(vault.select(F.col("row_pos").alias("item_pos"), "sku"), "item_pos").select(
        "query_id", F.col("item_pos").alias("row_pos"), "sku", "score")


def _best(scores: DataFrame) -> DataFrame:
    return scores.groupBy("q_cls").agg(F.min_by("item_pos", F.struct(-F.col("score"), F.col("item_pos"))).alias("item_pos"),
                                       F.max("score").alias("score"))


def _wide(q_cls: DataFrame, i_cls: DataFrame, best: DataFrame) -> DataFrame:
    """Scores of the pairs of classes of which one has more than ``PAIRED`` tokens, as far
    as they can beat ``best`` (score, then the earlier item).

    A query's tokens are taken from the most frequent on, as long as their weights together
    stay below its best score: an item with no other tokens loses.  Items are met by the
    remaining tokens, and those are dropped whose score from these and all of the former
    would still lose; only then is the rest of the score added up."""
    wide_i = i_cls.select("item_pos", F.explode("sig").alias("token"), (F.size("sig") > PAIRED).alias("i_wide"))
    held = wide_i.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.max("i_wide").alias("i_any"))
    by_token = Window.partitionBy("q_cls").orderBy(F.col("held").desc(), "token").rowsBetween(Window.unboundedPreceding, 0)
    q = (q_cls.select("q_cls", (F.size("qsig") > PAIRED).alias("q_wide"), F.inline("qsig"))
         .join(held, "token"))
    # queries that can meet no wide pair go at once
    meets = q.groupBy("q_cls").agg(F.max(F.col("q_wide") | F.col("i_any")).alias("m")).where("m").select("q_cls")
    q = (q.join(meets, "q_cls", "left_semi")
         .join(best.select("q_cls", F.col("item_pos").alias("best_pos"), F.col("score").alias("best")), "q_cls")
         .withColumn("so_far", F.sum("weight").over(by_token)))
    probe = F.col("so_far") >= F.col("best")
    light = F.max(F.when(~probe, F.col("so_far"))).over(Window.partitionBy("q_cls"))
    q = q.withColumns({"probe": probe, "light": F.coalesce(light, F.lit(0))})
    most = F.col("got") + F.col("light")
    left = (q.where("probe").join(wide_i, "token").where(F.col("q_wide") | F.col("i_wide"))
            .groupBy("q_cls", "item_pos", "best", "best_pos", "light").agg(F.sum("weight").alias("got"))
            .where((most > F.col("best")) | ((most == F.col("best")) & (F.col("item_pos") < F.col("best_pos")))))
    rest = (left.select("q_cls", "item_pos").join(q.where(~F.col("probe")).select("q_cls", "token", "weight"), "q_cls")
            .join(wide_i.select("item_pos", "token"), ["item_pos", "token"]).select("q_cls", "item_pos", "weight"))
    return (left.select("q_cls", "item_pos", F.col("got").alias("weight")).unionByName(rest)
            .groupBy("q_cls", "item_pos").agg(F.sum("weight").alias("score")))


def _pairs(items: Column, make) -> Column:
    """All pairs of an ordered array, earlier element first."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(
        F.slice(items, i + 2, F.size(items)), lambda y: make(x, y))))


# ------------------------------------------------------------------ quotes
def safe_quote(price_text: Column, cost: Column, multiplier: float) -> Column:
    """stored price when it parses (a stored 0 stays 0), else cost x m."""
    return F.coalesce(clean_number(price_text), cost * F.lit(multiplier))


def price_quotes(vault: DataFrame) -> DataFrame:
    """Cost and the standard / VIP / clearance quotes of every item,
    with their ``₹1,234`` texts (whole rupees, half-even like Python)."""
    cost = clean_number(F.col("sourcing_price_text"))
    q = vault.select("row_pos", "sku", cost.alias("cost"),
                     safe_quote(F.col("standard_price_text"), cost, STANDARD_X).alias("standard_quote"),
                     safe_quote(F.col("vip_price_text"), cost, VIP_X).alias("vip_quote"),
                     safe_quote(F.col("clearance_price_text"), cost, CLEARANCE_X).alias("clearance_quote"))
    return q.select("*", *[F.concat(F.lit("₹"), format_money(F.col(c), 0)).alias(c + "_text")
                           for c in ("standard_quote", "vip_quote", "clearance_quote")])


def default_price(vault: DataFrame) -> DataFrame:
    """Caption price from the newest item: Standard (VIP when that
    *column* is absent, else 1500) truncated to an integer; '' on failure."""
    if "standard_price_text" in vault.columns:
        src = F.col("standard_price_text")
    elif "vip_price_text" in vault.columns:
        src = F.col("vip_price_text")
    else:
        src = F.lit(str(DEFAULT_PRICE))
    newest = vault.agg(F.max_by(F.struct(F.col("sku"), src.cast("string").alias("p")), "row_pos").alias("n"))
    v = clean_number(F.col("n.p"))
    return newest.select(F.col("n.sku").alias("sku"),
                         F.coalesce(v.try_cast("bigint").cast("string"), F.lit("")).alias("default_price"))


# ------------------------------------------------------------------ gallery
def stock_badge(stock: Column) -> Column:
    return (F.when(stock >= 3, F.lit(BADGE_IN)).when(stock > 0, F.lit(BADGE_LOW)).otherwise(F.lit(BADGE_OUT)))


def gallery(vault: DataFrame, category: str = "All", hide_sold_out: bool = True, n: int = 6) -> DataFrame:
    """P5f/P6f/F18/H4: newest ``n`` items after the in-stock and category
    filters (case-insensitive substring of the tags, so ``Ring`` also
    matches ``Earrings``), newest first."""
    stock = F.coalesce(clean_number(F.col("stock_text")), F.lit(0.0))
    v = vault.withColumn("_stock", stock)
    if hide_sold_out:
        v = v.where(F.col("_stock") > 0)
    if category != "All":
        v = v.where(F.coalesce(F.lower(F.col("tags")).contains(category.lower()), F.lit(False)))
    top = v.orderBy(F.col("row_pos").desc()).limit(n)
    s = F.col("_stock").try_cast("bigint")
    return top.select("row_pos", "sku", s.alias("stock"), stock_badge(s).alias("stock_badge"),
                      F.concat(F.lit("Cost: ₹"), format_money(clean_number(F.col("sourcing_price_text")), 0))
                      .alias("cost_text"), "tags")


# ------------------------------------------------------------------ intake
def new_items(intake: DataFrame, vault: DataFrame, image_base: str = "https://img.example/") -> DataFrame:
    """Catalogue rows for an intake batch, appended
    after the current catalogue (``row_pos`` continues from its maximum).

    SKU = ``JK-<epoch seconds>-<4 upper hex>``; the hex comes from a hash
    of the intake id, so re-running a batch gives the same SKUs."""
    last = vault.agg(F.coalesce(F.max("row_pos"), F.lit(0).cast("bigint"))).scalar()
    sku = F.concat(F.lit("JK-"), F.unix_timestamp("intake_ts").cast("string"), F.lit("-"),
                   F.upper(F.substring(F.md5(F.col("intake_id").cast("string")), 1, 4)))
    cost = F.col("sourcing_price")

    def price(override: str, m: float) -> Column:
        return F.when(F.col(override) > 0, F.col(override)).otherwise(cost * F.lit(m))

    tags = F.when(F.coalesce(F.col("raw_tags"), F.lit("")) != "",
                  F.concat(F.col("category"), F.lit(", "), F.col("raw_tags"))).otherwise(F.col("category"))
    added = intake.select(
        (last + F.col("intake_id")).alias("row_pos"), sku.alias("sku"), cost.alias("sourcing_price"),
        tags.alias("tags"), F.concat(F.lit(image_base), sku).alias("image_url"),
        price("std_override", STANDARD_X).alias("standard_price"),
        price("vip_override", VIP_X).alias("vip_price"),
        price("clr_override", CLEARANCE_X).alias("clearance_price"),
        F.col("stock_qty"))
    return added


# ------------------------------------------------------------------ tagging
def parse_tag_response(text: Column) -> tuple[Column, Column]:
    """``Category: X | Tags: Y`` -> (first allowed category contained in
    X, case-insensitive, in list order, else ``Other``; Y).  Without a ``|``
    the result is (``Other``, '')."""
    t = clean_text(text)
    parts = F.split(t, r"\|")
    cat_part = F.lower(clean_text(F.replace(parts.getItem(0), F.lit("Category:"), F.lit(""))))
    tags_part = clean_text(F.replace(parts.getItem(1), F.lit("Tags:"), F.lit("")))
    chosen = F.lit("Other")
    for c in reversed(CATEGORIES):
        chosen = F.when(cat_part.contains(c.lower()), F.lit(c)).otherwise(chosen)
    has_sep = t.contains("|")
    return (F.when(has_sep, chosen).otherwise(F.lit("Other")),
            F.when(has_sep, tags_part).otherwise(F.lit("")))
