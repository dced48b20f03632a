"""SpotSigs fingerprints, in DataFrame functions only.

Method. At each common word (an anchor) the next two content words, those that
are not common, form a signature with it, however far away they are. A text's
fingerprint is its sorted set of signatures, as 8 hexadecimal digits
each. Sets are compared by Jaccard similarity. To find similar texts, sets are
partitioned by length so that only neighbouring lengths can meet, and candidates
are taken from the rarest signatures of each set: two sets with a similarity of
t share one among the first n - ceil(t * n) + 1 of either. Sets that are equal
are one class, so that copies do not meet pair by pair.

Signatures come from three regular expressions over the whole text: one makes
words of it, one marks the common ones, and one takes each run of anchors with
the content word after it, looking ahead over the next run for the second. A
match begins where the last one ended, so a run is read twice at most, and the time is
linear, however long the runs are. All anchors of a run have the same two content words.
Texts without a run of 32 anchors take each anchor's chain on its own, which looks ahead over fewer than 32.

Defined cases. A null text is empty. A text without any signature but with words
has one signature, of all its words; a text without words has the empty
fingerprint. Two empty fingerprints have a likeness of 1. Rows with equal ids
are ordered by a hash of their text; a row with a null id has no next text. An
empty table gives no rows, a single row is its own next. Very long texts are read
whole. Further columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import cut

#: Ids that a block of neighbouring documents spans hold about so many documents.
BLOCK = 256
#: There are at most FANOUT**2 blocks: an id finds its block in two steps of at most so many comparisons.
FANOUT = 256
# The common words of four languages.
COMMON = tuple(
    "the of and to in that is was for it with as be on by at this are from or an a he not his but have "
    "der die das und ist nicht von zu mit sich auf für als ein eine den im dem des auch es an "
    "le la les de et en un une que qui dans pour sur avec au du est pas il ne se ce "
    "el los las y por con para del su no lo como al más o pero".split()
)


#: One word, of which an anchor's begins with a mark that no word holds.
MARK = "\x01"
COMMON_WORD = rf"(?<=\x20)(?=(?:{'|'.join(COMMON)})\x20)"
#: An anchor's chain. It looks ahead over the anchors that follow, so it is used where no run is long; else whole runs are taken.
CHAIN = rf"\G[^{MARK}]*+{MARK}([^\x20]++)(?=(?:\x20{MARK}[^\x20]++)*+\x20([^{MARK}\x20]++)(?:\x20{MARK}[^\x20]++)*+\x20([^{MARK}\x20]++))"
LONG = rf"(?:{MARK}[^\x20]++\x20){{32}}"
RUN = rf"\G[^{MARK}]*+((?:{MARK}[^\x20]++\x20)++)([^{MARK}\x20]++)(?=(?:\x20{MARK}[^\x20]++)*+\x20([^{MARK}\x20]++))"


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures."""

    def hashed(chain: Column) -> Column:
        return F.substring(F.md5(chain.cast("binary")), 1, 8)

    def chains_of(run: Column) -> Column:
        """Each anchor of a run with the two content words after it: they follow a double blank."""

        def joined(parts: Column) -> Column:
            anchors = F.split(F.substring(F.get(parts, 0), 2, 1 << 30), f" {MARK}")
            return F.transform(anchors, lambda a: F.concat_ws(" ", a, F.get(parts, 1)))

        return F.element_at(F.transform(F.array(F.split(run, "  ")), joined), 1)  # splits once, not for each anchor

    def chains_in(marked: Column) -> Column:
        def lines(pattern: str) -> Column:
            every = F.split(F.regexp_replace(marked, pattern, "$1 $2 $3\n"), "\n")
            return F.slice(every, 1, F.size(every) - 1)

        return F.when(F.rlike(marked, F.lit(LONG)), F.flatten(F.transform(lines(RUN), chains_of))).otherwise(lines(CHAIN))

    def of(words: Column) -> Column:
        """words: each with a blank before and one after the last; only a blank if there is none."""
        chains = F.element_at(F.transform(F.array(F.regexp_replace(words, COMMON_WORD, MARK)), chains_in), 1)
        found = F.array_sort(F.array_distinct(F.transform(chains, hashed)))
        return F.when((F.size(found) == 0) & (F.length(words) > 1), F.array(hashed(F.trim(words)))).otherwise(found)

    words = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]++", " ")
    # One pass of transform binds the words once, whatever the number of uses.
    return F.element_at(F.transform(F.array(words), of), 1)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, id_col: str, carried: tuple[str, ...], made: dict[str, Column]) -> DataFrame:
    """docs with the columns `made`, and next_<c> for each c of carried: the row's successor by id; the first row follows the last.

    Blocks of neighbouring ids, between quantiles of the ids, are sorted on their
    own, so that a block holds about as many rows as any other, wherever the ids are
    dense. Each block also gets a copy of the first row of the block after it, found
    from the ids alone, so every row is shuffled once; `made` is computed after that
    shuffle. Only the list of blocks, at most FANOUT**2 rows, is sorted in one
    task and broadcast.
    """
    known = docs.filter(F.col(id_col).isNotNull())
    n = known.select(id_col).count()
    number = min(FANOUT**2, max(1, n // BLOCK))
    within = F.percentile_approx(id_col, [k / number for k in range(1, number)] or [0.5], max(10_000, 4 * number))
    ends = sorted(set(known.agg(within.alias("p")).first()["p"] or []))
    groups = [ends[k : k + FANOUT] for k in range(0, len(ends), FANOUT)] or [[0]]

    def constant(value: list) -> str:
        """SQL of nested arrays of numbers, which the optimiser folds into one constant."""
        return "array(" + ", ".join(constant(x) if isinstance(x, list) else f"{int(x)}L" for x in value) + ")"

    def passed(ends: Column) -> Column:
        """How many of these ends are not above the id."""
        return F.size(F.filter(ends, lambda e: e <= F.col(id_col).cast("long")))

    group = passed(F.expr(constant([g[0] for g in groups])))
    inside = passed(F.element_at(F.expr(constant(groups)), F.greatest(group, F.lit(1))))
    block = (group * (FANOUT + 1) + inside).cast("long")
    order = Window.orderBy("_block")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = known.groupBy(block.alias("_block")).agg(F.min(id_col).alias(id_col))
    firsts = cut(firsts.select(id_col, F.coalesce(F.lag("_block").over(order), F.max("_block").over(everything)).alias("_block")))
    rows = known.withColumns({"_block": block, "_copy": F.lit(0)})
    copies = known.join(F.broadcast(firsts), id_col).withColumn("_copy", F.lit(1)).select(*rows.columns)
    dealt = rows.unionAll(copies).repartition(F.col("_block")).withColumns(made)
    place = Window.partitionBy("_block").orderBy("_copy", id_col, F.xxhash64(*docs.columns))
    nexts = {f"next_{c}": F.lead(c).over(place) for c in carried}
    placed = dealt.withColumns(nexts).filter("_copy = 0").drop("_block", "_copy")
    alone = docs.filter(F.col(id_col).isNull()).withColumns(made)
    alone = alone.withColumns({f"next_{c}": F.lit(None).cast(dict(placed.dtypes)[c]) for c in carried})
    return placed.unionAll(alone.select(*placed.columns))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and signatures of every row."""
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("signatures", signatures(F.col("text")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and how like its own the edited and the next one are.

    The edited text's last half is the next text's beginning.
    """
    slim = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(slim, id_col, ("text", "signatures"), {"signatures": signatures(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    after = F.coalesce(F.substring(F.col("next_text"), F.lit(1), half), F.lit(""))
    edited = rows.select(
        id_col, n.cast("long").alias("n_chars"), "signatures", F.coalesce("next_signatures", F.array().cast("array<string>")).alias("following"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), after).alias("edited"),
    ).withColumn("changed", signatures(F.col("edited")))
    return edited.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("changed")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("following")).alias("near_next"),
    )


def similar_classes(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(membership: id, class; pairs: a, b, similarity) of texts by their signatures.

    A class is the set of rows with equal, non-empty signatures, named by its
    least id; pairs are all pairs of classes that are at least `threshold` alike.
    """
    named = prints.filter(F.size("signatures") > 0).withColumn("key", F.sha2(fingerprint(F.col("signatures")), 256))
    classes = named.groupBy("key").agg(F.min(id_col).alias("class"), F.first("signatures").alias("s"))
    membership = named.select(id_col, "key").join(classes.select("key", "class"), "key").select(id_col, "class")
    each = classes.select("class", F.size("s").alias("n"), F.explode("s").alias("sig"))
    seen = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(seen, "sig").withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("df", "sig")))
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    # Lengths from t to 1 times another's lie in the same or the next partition of a geometric scale.
    scale = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    short = prefix.select("sig", F.col("class").alias("a"), F.col("n").alias("na"), scale.alias("part"))
    long = prefix.select("sig", F.col("class").alias("b"), F.col("n").alias("nb"), F.explode(F.array(scale, scale - 1)).alias("part"))
    ahead = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = short.join(long, ["sig", "part"]).filter(ahead & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    sets = classes.select("class", "s")
    both = met.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    pairs = both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
    return membership, pairs
