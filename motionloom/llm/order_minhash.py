"""Document fingerprints by Order MinHash, sensitive to edit distance.

Method: the k-mers of a text are numbered by occurrence, so that the third occurrence of a k-mer is
another element than the first. Each of `BINS` signatures selects the two elements that are
minimal under a hash, keeps them in the order in which they stand in the text, and hashes that tuple.
Likeness is the share of signatures that agree: a text with the same k-mers in another order differs.

One hash deals elements to signatures (each signature sees its own share of the elements), so that a
text is passed over once. A first occurrence has the hash of its k-mer, a later one the hash of that
and its number. Every occurrence of every k-mer is an element. K-mers are runs of `RUN` code points, in
texts of every length and script; a shorter text is one run. Elements above a hash limit are set aside
before the last sort only where each signature has two below it, which changes no signature.

DataFrame functions only, in steps of one projection each, so that arrays of longs are sorted by
generated code. An edited text takes the k-mers of the part it kept from the text. The neighbour of a
document in the order of ids is found on (id, content hash) alone, within ranges of ids; texts move
twice through one and the same shuffle: to hand the first code points to the predecessor, and to take
them.

Edge cases: a null text is empty; an empty text has a fingerprint without signatures, alike to itself
only; repeated rows with one id and text count once in the order and get equal rows; texts with one id
are ordered by a hash; a null id is the first; a single document is its own neighbour; an empty table
gives an empty result; extra columns are ignored; equal hashes keep the order of the text; a text may
have 67 million code points, a row's limit of 2 GB being nearer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, ready

BINS = 32
#: An element is one long: 35 bits of hash, the last five of which name the signature, and its place in the text.
BIN_BITS, PLACE_BITS = 5, 28
PLACES = (1 << PLACE_BITS) - 1
HASHES = ((1 << 63) - 1) & ~PLACES
LARGEST = (1 << 63) - 1
#: Elements that a text is thinned to before the last sort, if each signature has its two among them.
SORTED = 320
#: Code points of a k-mer: few enough for an edit in a short text, enough for runs of long texts to differ.
RUN = 8
NO_ID = -(1 << 63)
ABSENT = "--------"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row; what a lambda names of a row would be read anew each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _no_longs() -> Column:
    return F.slice(F.array(F.lit(0).cast("long")), 1, 0)  # of a type without nulls, so that sorts stay on plain longs


def _grams(text: Column, first: Column | int = 0) -> Column:
    """All k-mers from k-mer number `first` on, each as the element of a first occurrence, in text order."""
    return _let(F.encode(text, "UTF-32"), lambda points: _runs(points, first))


def _runs(points: Column, first: Column | int) -> Column:
    count = F.when(F.length(points) == 0, 0).otherwise(F.greatest((F.length(points) / 4 - (RUN - 1)).cast("int"), F.lit(1)))
    at = F.sequence(F.lit(4) * first + 1, 4 * count - 3, F.lit(4))
    each = F.transform(at, lambda i: F.xxhash64(F.substring(points, i, F.lit(4 * RUN))).bitwiseAND(F.lit(HASHES)).bitwiseOR(i.cast("long")))
    return F.when(count > first, each).otherwise(_no_longs())


def _by_signature(elements: Column) -> Column:
    """Elements with the signature's number before the hash, sorted."""
    top = 63 - BIN_BITS
    moved = lambda e: F.shiftleft(F.shiftright(e, PLACE_BITS).bitwiseAND(F.lit(BINS - 1)), top).bitwiseOR(
        F.shiftleft(F.shiftright(e, PLACE_BITS + BIN_BITS), PLACE_BITS).bitwiseOR(e.bitwiseAND(F.lit(PLACES)))
    )
    return F.sort_array(F.transform(elements, moved))


def _signatures(dealt: Column) -> Column:
    """Map from signature number to 8 hex digits, from elements of _by_signature: the two smallest of each, in text order."""
    bin_of = lambda e: F.shiftright(e, 63 - BIN_BITS)
    place = lambda e: e.bitwiseAND(F.lit(PLACES))
    hash_of = lambda e: F.shiftright(e, PLACE_BITS)

    def sign(e, j):
        second = F.when(bin_of(F.get(dealt, j + 1)) == bin_of(e), F.get(dealt, j + 1))
        swapped = place(second) < place(e)
        signature = F.when(swapped, F.xxhash64(hash_of(second), hash_of(e))).otherwise(F.xxhash64(hash_of(e), hash_of(second)))
        found = F.struct(bin_of(e).alias("bin"), F.right(F.lower(F.lpad(F.hex(signature), 16, "0")), F.lit(8)).alias("s"))
        return F.when((j == 0) | (bin_of(F.get(dealt, j - 1)) != bin_of(e)), found)

    return F.map_from_entries(F.filter(F.transform(dealt, sign), F.isnotnull))


def fingerprinted(df: DataFrame, grams: dict[str, Column]) -> DataFrame:
    """Adds a column of BINS signatures, 8 hex digits each, ABSENT where a signature has no element, for each entry of
    `grams` (name to elements of `_grams`)."""
    keep, numbers = df.columns, range(len(grams))

    def step(what: str, made) -> None:
        nonlocal df
        df = df.withColumns({f"_{what}{n}": made(lambda x, n=n: F.col(f"_{x}{n}")) for n in numbers})

    apart = lambda x, other: x.bitwiseXOR(other) > F.lit(PLACES)  # noqa: E731  another k-mer
    new = lambda all_: lambda x, j: (j == 0) | apart(x, F.get(all_, j - 1))
    again = lambda all_: lambda x, j: x.bitwiseXOR(F.get(all_, j - 1)) <= F.lit(PLACES)  # noqa: E731  none before the first: null

    def starts(c):  # where a k-mer's later occurrences begin
        edge = _let(c("later"), lambda all_: F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda j: new(all_)(F.get(all_, j), j)))
        return F.when(F.size(c("later")) > 0, edge).otherwise(F.slice(F.array(F.lit(0)), 1, 0))

    def numbered(c):
        stop = lambda n: F.coalesce(F.get(c("starts"), n + 1), F.size(c("later")))
        counted = F.flatten(F.transform(c("starts"), lambda at, n: F.sequence(F.lit(2), stop(n) - at + 1)))
        hashed = lambda x, o: F.xxhash64(F.shiftright(x, PLACE_BITS), o).bitwiseAND(F.lit(HASHES)).bitwiseOR(x.bitwiseAND(F.lit(PLACES)))
        return F.zip_with(c("later"), counted, hashed)

    def low(c):
        few = F.when(c("limit") == LARGEST, c("sorted")).otherwise(F.slice(c("sorted"), 1, SORTED))
        return _by_signature(F.concat(F.filter(few, new(c("sorted"))), F.filter(c("numbered"), lambda x: x <= c("limit"))))

    def dealt(c):
        bin_ = lambda e: F.shiftright(e, 63 - BIN_BITS)
        pairs = lambda all_: lambda x, j: (bin_(F.get(all_, j - 1)) == bin_(x)) & ~F.coalesce(bin_(F.get(all_, j - 2)) == bin_(x), F.lit(False))
        second = _let(c("low"), lambda all_: F.filter(all_, pairs(all_)))
        every = _by_signature(F.concat(F.filter(c("sorted"), new(c("sorted"))), c("numbered")))
        return F.when((c("limit") == LARGEST) | (F.size(second) == BINS), c("low")).otherwise(every)

    df = df.withColumns({f"_sorted{n}": F.sort_array(g) for n, g in enumerate(grams.values())})
    step("limit", lambda c: F.when(F.size(c("sorted")) <= 2 * SORTED, LARGEST).otherwise(F.get(c("sorted"), F.lit(SORTED - 1))))
    step("later", lambda c: _let(c("sorted"), lambda all_: F.filter(all_, again(all_))))
    step("starts", starts)
    step("numbered", numbered)
    step("low", low)
    step("dealt", dealt)
    step("signed", lambda c: _let(c("dealt"), _signatures))
    bins = F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))
    told = lambda signed: F.transform(bins, lambda b: F.coalesce(F.try_element_at(signed, b), F.lit(ABSENT)))
    return df.select(*keep, *[_let(F.col(f"_signed{n}"), told).alias(name) for n, name in enumerate(grams)])


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a column of texts."""
    return fingerprinted(df, {out: _grams(F.coalesce(text_col, F.lit("")))})


def likeness(a: Column, b: Column) -> Column:
    """Share of the signatures present in either fingerprint that agree; 1 if neither has any."""
    present = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != ABSENT) | (y != ABSENT)), lambda p: p))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != ABSENT)), lambda p: p))
    return F.when(present == 0, F.lit(1.0)).otherwise(equal / present)


def successors(keys: DataFrame) -> DataFrame:
    """keys: kid, content and more, one row each. Adds nkid, ncontent of the next key in order, the first after the last."""
    key = F.struct("kid", "content")
    ranged = cut(keys.repartitionByRange("kid", "content").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))  # a row for each range
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"))
    inside = F.lead(key).over(Window.partitionBy("part").orderBy("kid", "content"))
    told = ranged.withColumn("inside", inside).join(F.broadcast(after), "part").withColumn("next", F.coalesce("inside", "after"))
    return told.select(*keys.columns, F.col("next.kid").alias("nkid"), F.col("next.content").alias("ncontent"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kid, content, text, edited, nkid, ncontent of every row: the last floor(n/4) code points replaced by the first as
    many of the next document."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("kid"), F.xxhash64(text, F.length(text)).alias("content"), text.alias("text"))
    thin = rows.select("kid", "content", F.floor(F.length("text") / 4).cast("int").alias("quarter"))
    keys = cut(successors(thin.groupBy("kid", "content").agg(F.max("quarter").alias("quarter"), F.count("*").alias("copies"))))
    wanted = keys.select(
        F.col("kid").alias("for_kid"), F.col("content").alias("for_content"), "quarter",
        F.col("nkid").alias("kid"), F.col("ncontent").alias("content"),
    )
    given = rows.join(wanted, ["kid", "content"]).select(
        F.col("for_kid").alias("kid"), F.col("for_content").alias("content"), F.left("text", F.col("quarter")).alias("given"),
        F.col("kid").alias("nkid"), F.col("content").alias("ncontent"),
    )
    if not keys.where("copies > 1").isEmpty():  # repeated rows hand over the same text
        given = given.dropDuplicates(["kid", "content"])
    kept = F.length("text") - F.floor(F.length("text") / 4)
    return rows.join(given, ["kid", "content"]).select(
        "kid", "content", "text", F.concat(F.left("text", kept.cast("int")), "given").alias("edited"), "nkid", "ncontent"
    )


def op3_fingerprints(docs: DataFrame) -> DataFrame:
    texts = edited(docs).select(
        "kid", "content", "nkid", "ncontent", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.greatest(F.length("text") - F.floor(F.length("text") / 4).cast("int") - (RUN - 1), F.lit(0)).alias("shared"),
        "edited", _grams(F.col("text")).alias("own"),
    )
    both = F.concat(F.slice("own", F.lit(1), F.col("shared")), _grams(F.col("edited"), F.col("shared")))
    marked = cut(fingerprinted(texts, {"fp": F.col("own"), "efp": both}).drop("own", "shared", "edited"))
    after = marked.select(F.col("kid").alias("nkid"), F.col("content").alias("ncontent"), F.col("fp").alias("nfp"))
    return marked.join(after.dropDuplicates(["nkid", "ncontent"]), ["nkid", "ncontent"]).select(
        F.nullif("kid", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256",
        F.array_join("fp", "").alias("fingerprint"), F.array_join("efp", "").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
