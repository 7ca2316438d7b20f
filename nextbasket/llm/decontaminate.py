"""Benchmark decontamination: template windows with typed placeholders are hash-joined, then slots are checked for consistency.

Numbers, names and units become placeholders, whole numbers ('1,200.5') and names of several words ('Mary Ann') one each, so
a question whose values were changed has the same template, whatever the width of the values. A hit has to
cover enough of an item on one diagonal (document place minus item place), and every value of the item has to be
replaced by the same value wherever it stands. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: A capital word after a word that ends no sentence: a name.
NAME = r"(?<=[^.!?:\s]\s)(?=\p{Lu}\p{Ll})"
MARK, JOIN = "\x01", "\x02"
#: Between two words of one name: a space and the mark of the second, or a hyphen or apostrophe before a capital word.
IN_NAME = r"(?:\s\x01|['’-](?=\p{Lu}\p{Ll}))(?<=\x01[\p{L}\p{N}'’-]{1,99}(?:\s\x01|['’-]))"
#: Separators between two digits belong to a number. Runs are matched by one class alone: a repeated group would take the stack's depth by their length.
NOT_TOKEN = r"[^\p{L}\p{N}\x01\x02.,:/'’]++|[.,:/'’](?!(?<=[0-9].)[0-9])"
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "miles", "mg", "g", "kg", "lb", "tons", "ml", "l", "liters", "litres", "ms", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "percent", "usd", "eur", "dollars", "euros", "cents", "kmh", "mph", "degrees")
#: Number words of the corpus's languages, from two on (one is an article in most).
NUMBERS = tuple("""
two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve
veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze seize vingt trente quarante cinquante soixante cent mille
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
""".split())
WIDTH = 8


def spelled(text):
    """Words in lower case, without punctuation, one space apart; names begin with MARK. A number with its separators is one word, and so is a name of several, with JOIN between them."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARK + JOIN, "  ")
    marked = F.regexp_replace(F.regexp_replace(plain, NAME, MARK), IN_NAME, JOIN)
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(marked, NOT_TOKEN, " "), " {2,}", " ")))


def formed(df: DataFrame, keep: list[str], form: str) -> DataFrame:
    """df (with a column text) with form and token, a row for each form: 0 with each word of a name for itself, 1 with names of several words as one, if there are any.

    Whether the first word of a sentence belongs to a name depends on what stands before it, so one form alone would miss hits.
    """
    df = df.select(*keep, spelled(F.col("text")).alias("spelled"))
    both = F.array_distinct(F.array(F.replace("spelled", F.lit(JOIN), F.lit(" " + MARK)), "spelled"))
    return df.select(*keep, F.posexplode_outer(both).alias(form, "spelled")).select(*keep, form, F.split("spelled", " +").alias("token"))


def is_number(x):
    return F.ascii(x).between(48, 57) | x.isin(*NUMBERS)


def template(x, before):
    """The token, or the type of its slot."""
    return F.when(F.ascii(x) == 1, "<name>").when(is_number(x), "<number>").when(x.isin(*UNITS) & is_number(before), "<unit>").otherwise(x)


def windows(df: DataFrame) -> DataFrame:
    """df (with a column token) with hash: of each window of WIDTH template tokens, by doubling; shorter texts have none.

    Take it apart by an outer explode: a plain one filters on the array's size, and that filter would inline all levels.
    """
    h = F.transform("token", lambda x, i: F.xxhash64(template(x, F.when(i > 0, F.get("token", i - 1)))))
    df = df.withColumn("hash", h)
    for step in (1, 2, 4):  # WIDTH is 8
        df = df.withColumn("hash", _joined(step))
    return df


def _joined(step: int):
    """Hashes of twice as long windows: of each hash with the one step places on."""
    return F.transform(F.slice("hash", 1, F.greatest(F.size("hash") - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("hash", i + step)))


def reach(windows_: DataFrame) -> DataFrame:
    """item_row, item_form, reach: the tokens that an item's windows cover together."""
    form = ["item_row", "item_form"]
    new = F.least(F.lit(WIDTH), F.coalesce(F.col("item_at") - F.lag("item_at").over(Window.partitionBy(*form).orderBy("item_at")), F.lit(WIDTH)))
    return windows_.select(*form, new.alias("new")).groupBy(*form).agg(F.sum("new").alias("reach"))


def item_windows(benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """Of benchmark(item_id, item_row, text): item_id, item_row, item_form, item_at, item_tokens, item_slice, slots, hash.

    Windows of more than half placeholders are left out, as they fit too much. Where the others cover less than a hit needs, as in short questions full of names and values,
    dense ones stay that have two plain tokens or more, if the item has three or more.
    """
    items = formed(benchmark, ["item_id", "item_row"], "item_form")
    each = windows(items).select("item_id", "item_row", "item_form", "token", F.posexplode_outer("hash").alias("item_at", "hash"))
    slot = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: _slot(F.get("token", F.col("item_at") + k), F.get("token", F.col("item_at") + k - 1)))
    item_plain = F.size(F.filter(F.transform("token", lambda x, i: _slot(x, F.when(i > 0, F.get("token", i - 1)))), lambda x: ~x))
    out = each.where("hash is not null").select("item_id", "item_row", "item_form", "item_at", F.size("token").alias("item_tokens"), item_plain.alias("item_plain"), F.slice("token", F.col("item_at") + 1, WIDTH).alias("item_slice"), slot.alias("slots"), "hash")
    out, dense = saved(out), F.size(F.filter("slots", lambda x: x)) * 2 > WIDTH
    plain = F.size(F.filter("slots", lambda x: ~x))
    out = out.join(reach(out.where(~dense)), ["item_row", "item_form"], "left").where(~dense | (plain >= 2) & (F.col("item_plain") >= 3) & (F.coalesce("reach", F.lit(0)) < needs(least, share)))
    return saved(out.drop("reach", "item_plain"))


def needs(least: int, share: float):
    """The tokens that a hit of an item has to cover."""
    return F.least(F.lit(least), F.ceil(F.col("item_tokens") * share))


def whole_keys(benchmark: DataFrame, items: DataFrame, least: int, share: float) -> DataFrame:
    """item_id, item_row, item_form, item_tokens, item_slice, slots, width, raw, hash: of each item form whose windows (items) cover less than a hit needs.

    The hash is that of the first `width` tokens (WIDTH, or all of a shorter item): of their templates, or where placeholders
    prevail or the item is longer, of the tokens (raw). item_slice and slots are those of the whole item.
    """
    form = ["item_row", "item_form"]
    all_items = formed(benchmark, ["item_id", "item_row"], "item_form").where(F.get("token", F.lit(0)) != "")
    n = F.size("token")
    short = all_items.join(reach(items), form, "left").where(F.coalesce("reach", F.lit(0)) < F.least(F.lit(least), F.ceil(n * share)))
    slots = F.transform("token", lambda x, i: _slot(x, F.when(i > 0, F.get("token", i - 1))))
    short = short.select("item_id", *form, n.alias("item_tokens"), F.col("token").alias("item_slice"), slots.alias("slots"), F.least(n, F.lit(WIDTH)).alias("width"))
    raw = (F.col("item_tokens") >= WIDTH) | (F.size(F.filter("slots", lambda x: x)) * 2 > F.col("item_tokens"))
    short = short.withColumn("raw", raw)
    hash_ = F.lit(None).cast("long")
    for width in range(1, WIDTH + 1):
        for is_raw in (False, True):
            hash_ = F.when((F.col("width") == width) & (F.col("raw") == is_raw), _key("item_slice", F.lit(0), width, is_raw)).otherwise(hash_)
    return short.withColumn("hash", hash_)


def _unmarked(x):
    """An item's first token is no name; whether that of its copy seems to be one depends on what stands before."""
    return F.replace(x, F.lit(MARK), F.lit(""))


def _key(tokens: str, at, width: int, raw: bool):
    """The hash of so many tokens, or their templates, from a place on; width and raw tell kinds of keys apart."""
    first = _unmarked(F.get(tokens, at))
    one = lambda k: first if raw and not k else F.get(tokens, at + k) if raw else template(F.get(tokens, at + k), F.get(tokens, at + k - 1)) if k else template(first, F.lit(None).cast("string"))
    return F.xxhash64(F.lit(width), F.lit(raw), *(one(k) for k in range(width)))


def _keys(width: int, raw: bool):
    """The places of a text's keys of this kind, and their hashes."""
    begins = F.slice("token", 1, F.greatest(F.size("token") - width + 1, F.lit(0)))
    return F.transform(begins, lambda _, at: F.struct(at.alias("doc_at"), _key("token", at, width, raw).alias("hash")))


def _slot(x, before):
    return F.coalesce((F.ascii(x) == 1) | is_number(x) | (x.isin(*UNITS) & is_number(before)), F.lit(False))


def size_of(items: DataFrame) -> int:
    """Bytes that the rows take in memory, from above: strings with their heads, slots and numbers."""
    row = 200 + 32 * F.size("item_slice") + F.octet_length(F.array_join("item_slice", ""))
    return items.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]  # one row


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, text_hash, item_id, doc_at, item_at, covered, item_tokens, slots, kind: the best diagonal of each document and item.

    A hit covers `least` tokens, or `share` of a shorter item. kind: verbatim (`share` of the item at least, with its values), partial (less of it,
    with its values) or reparameterised; hits whose slots are replaced inconsistently are left out. Items whose windows cover less, as they are short or made mainly of placeholders, are
    found where they stand whole, by one key each: short ones by their template, those made almost wholly of placeholders and longer ones
    verbatim. An item without any token is never found. The windows of the benchmark go to the tasks where they take at most broadcast_bytes, which are summed; otherwise both sides shuffle.
    Nulls: null texts have no window, null ids stay. Repeated rows of documents each give a row, repeated items each count.
    Of diagonals that cover as much the first in the document counts. Texts of any length are whole, also runs of separators alone.
    Empty tables give no rows. Other columns, whatever their names, are dropped.
    """
    benchmark = saved(benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("item_row")))  # written once, so that a row keeps its number
    items = item_windows(benchmark, least, share)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    texts = formed(texts, ["doc_id", "text_hash", "row"], "form")
    item = ["item_id", "item_row", "item_form", "item_at", "item_tokens", "item_slice", "slots"]
    known = texts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("form").alias("_form"), "token").dropDuplicates(["_id", "_hash", "_form"])
    same_text = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("form") == F.col("_form"))
    part = F.slice("token", F.col("doc_at") + 1, WIDTH).alias("doc_slice")
    if size_of(items) <= broadcast_bytes:
        each = windows(texts).select("doc_id", "text_hash", "row", "form", "token", F.posexplode_outer("hash").alias("doc_at", "hash"))
        hits = each.join(F.broadcast(items), "hash").select("doc_id", "text_hash", "row", "form", "doc_at", *item, part)
    else:  # windows shuffle without their texts; those of hits come by a second join
        each = windows(texts).select("doc_id", "text_hash", "row", "form", F.posexplode_outer("hash").alias("doc_at", "hash"))
        found = each.join(items, "hash").select("doc_id", "text_hash", "row", "form", "doc_at", *item)
        hits = found.join(known, same_text).select("doc_id", "text_hash", "row", "form", "doc_at", *item, part)
    hits = hits.withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
    line = ["doc_id", "text_hash", "row", "form", "item_id", "item_row", "item_form", "item_tokens", "diagonal"]
    new = F.least(F.lit(WIDTH), F.coalesce(F.col("doc_at") - F.lag("doc_at").over(Window.partitionBy("row", "form", "item_row", "item_form", "diagonal").orderBy("doc_at")), F.lit(WIDTH)))
    pair = F.transform(F.filter(F.arrays_zip(F.col("item_slice").alias("item"), F.col("doc_slice").alias("doc"), F.col("slots").alias("slot")), lambda x: x["slot"]), lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc")))
    # an item's windows bound the rows of a diagonal
    found = hits.select(*line, "doc_at", "item_at", new.alias("new"), pair.alias("pair"))
    found = found.groupBy(*line).agg(F.min("doc_at").alias("doc_at"), F.min("item_at").alias("item_at"), F.sum("new").alias("covered"), F.array_distinct(F.flatten(F.collect_list("pair"))).alias("pairs"))
    whole = whole_keys(benchmark, items, least, share)
    kinds = sorted(tuple(r) for r in whole.select("width", "raw").distinct().collect())  # WIDTH + 7 at most
    if kinds:
        each = texts.select("doc_id", "text_hash", "row", "form", "token", F.explode_outer(F.flatten(F.array(*(_keys(*kind) for kind in kinds)))).alias("key")).select("doc_id", "text_hash", "row", "form", "token", "key.*")
        if size_of(whole) <= broadcast_bytes:
            each = each.join(F.broadcast(whole), "hash")
        else:
            each = each.drop("token").join(whole, "hash").join(known, same_text)
        each = each.withColumn("doc_slice", F.concat(F.array(_unmarked(F.get("token", "doc_at"))), F.slice("token", F.col("doc_at") + 2, F.col("item_tokens") - 1))).where("not raw or item_slice = doc_slice")
        each = each.select(*line[:-1], (F.col("doc_at") + 0).alias("diagonal"), "doc_at", F.lit(0).alias("item_at"), F.col("item_tokens").cast("long").alias("covered"), F.array_distinct(pair).alias("pairs"))
        found = found.unionByName(each)
    distinct = F.size(F.array_distinct(F.transform("pairs", lambda x: x["item"])))
    found = found.where((F.col("covered") >= needs(least, share)) & (distinct == F.size("pairs")))
    best = F.row_number().over(Window.partitionBy("row", "item_row").orderBy(F.desc("covered"), "diagonal", "form", "item_form"))
    same = F.forall("pairs", lambda x: x["item"] == x["doc"])
    return found.withColumn("best", best).where("best = 1").select("doc_id", "text_hash", "item_id", "doc_at", "item_at", "covered", "item_tokens", F.size("pairs").alias("slots"), F.when(~same, "reparameterised").when(F.col("covered") < F.col("item_tokens") * share, "partial").otherwise("verbatim").alias("kind"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item. Null texts and ids stay; of rows that repeat a doc_id each is judged by its own text."""
    i, h = [n for n in (f"_{k}" for k in range(len(docs.columns) + 2)) if n not in docs.columns][:2]
    bad = leaks(docs, benchmark, **limits).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds, with place, covered tokens and kind."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
