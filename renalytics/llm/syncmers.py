"""Document fingerprints from closed syncmers (operator 4), in DataFrame functions only.

A text's symbols are its non-blank characters, whatever its script, so any two fingerprints are comparable.
A k-mer of ``TEXT_K`` symbols is a closed syncmer when the smallest hash among its inner substrings of ``TEXT_S``
symbols lies at its first or last place; ``closed_syncmers`` takes other symbols and lengths as well.
The choice looks at the k-mer alone, not at what surrounds it, so an edit changes only the anchors that
it touches.  A fingerprint keeps the ``ANCHORS`` smallest distinct anchors: 40 bits of the k-mer's
hash and 24 bits of its position.  Two fingerprints are alike in the share of the smallest anchors of
both that match: same hash, and positions that differ by about as much as the other matches do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from renalytics.llm.common import free_name

K = 5                    # of symbol arrays, such as the words of a text
S = 2
TEXT_K = 8               # of the characters of a text
TEXT_S = 3
ANCHORS = 48
POSITION_BITS = 24
BUCKET_ROWS = 512        # rows that find their next neighbour in one window partition
MAX_BUCKETS = 1 << 16    # bounds the broadcast table of first rows (two numbers each)
KNOTS = 64
BLANKS = "\n\t\r\x0b\x0c"
RARE_BLANKS = 20         # characters per word from which a text is taken by characters


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hashed: Column, position: Column) -> Column:
    cap = (1 << POSITION_BITS) - 1
    place = F.least(position.cast("long"), F.lit(cap).cast("long"))
    return F.shiftleft(F.shiftright(hashed, POSITION_BITS), POSITION_BITS).bitwiseOR(place)


def words(text: Column) -> Column:
    """Runs of non-blank characters of a text, in order."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def characters(text: Column) -> Column:
    """Non-blank code points of a text, in order."""
    return _let(F.translate(text, BLANKS + " ", ""),
                lambda kept: F.when(kept == "", F.array().cast("array<string>")).otherwise(F.split(kept, "")))


def symbols(text: Column) -> Column:
    """Coarser symbols: the words of a text, or its characters where blanks are rare."""
    return _let(words(text), lambda w: F.when(F.length(text) > RARE_BLANKS * F.size(w), characters(text)).otherwise(w))


def _anchors(words: Column, k: int, s: int, offset: Column) -> Column:
    """Packed anchors of a symbol array in text order; places count from ``offset``."""
    w = k - s + 1

    def chosen(inner: Column) -> Column:
        def at(i, j):
            return F.get(inner, i + j)

        def pick(x, i):
            # Beyond the last k-mer ``last`` is null, so neither side holds.
            last = at(i, w - 1)
            least = F.when(x <= last, reduce(lambda a, b: a & b, [x <= at(i, j) for j in range(1, w - 1)], F.lit(True))).otherwise(
                reduce(lambda a, b: a & b, [last <= at(i, j) for j in range(1, w - 1)], last < x))
            hashed = F.xxhash64(x, *[at(i, j) for j in sorted({*range(s, w - 1, s), w - 1})])
            return F.when(least, _packed(hashed, i + offset))

        return F.filter(F.transform(inner, pick), lambda a: a.isNotNull())

    hashes = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, s)]))
    return _let(F.slice(hashes, 1, F.greatest(F.size(words) - (s - 1), F.lit(0))), chosen)


def _or_whole(anchors: Column, words: Column) -> Column:
    """The anchors of a symbol array; the whole array is the anchor if it has none."""
    whole = F.array(_packed(F.xxhash64(words), F.lit(0)))
    return _let(anchors, lambda a: F.when(F.size(a) > 0, a).when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(whole))


def closed_syncmers(words: Column, k: int = K, s: int = S) -> Column:
    """Packed anchors of a symbol array in text order; the whole array is the anchor if it has none."""
    return _or_whole(_anchors(words, k, s, F.lit(0)), words)


def _smallest(anchors: Column) -> Column:
    """Smallest anchors with distinct hashes, ascending."""
    distinct = _let(F.sort_array(anchors), lambda a: F.filter(a, lambda x, i: (i == 0) | (
        F.shiftright(x, POSITION_BITS) != F.shiftright(F.get(a, i - 1), POSITION_BITS))))
    return F.slice(distinct, 1, ANCHORS)


def sketch(text: Column) -> Column:
    """The fingerprint as an array: smallest anchors with distinct hashes, ascending."""
    return _smallest(_let(characters(F.coalesce(text, F.lit(""))), lambda c: closed_syncmers(c, TEXT_K, TEXT_S)))


def sketches(frame: DataFrame, head: str, tails: dict[str, Column]) -> DataFrame:
    """``frame`` with the sketches of the texts that begin with column ``head`` and go on with each of ``tails``.

    The choice of an anchor looks at its k-mer alone, so the anchors of the common head are found once; those that
    end in a tail come from the last ``TEXT_K`` - 1 characters of the head and the tail.
    """
    letters, anchors, over = (free_name(frame, c) for c in ("head_letters", "head_anchors", "head_over"))
    out = frame.withColumn(letters, characters(F.col(head)))
    out = out.withColumn(anchors, _anchors(F.col(letters), TEXT_K, TEXT_S, F.lit(0))).withColumn(
        over, F.greatest(F.size(letters) - (TEXT_K - 1), F.lit(0)))
    out = out.withColumn(letters, F.when(F.size(anchors) == 0, F.col(letters)).otherwise(
        F.slice(letters, F.col(over) + 1, TEXT_K - 1)))

    def made(tail: Column) -> Column:
        def of(after: Column) -> Column:
            both = F.concat(F.slice(letters, F.greatest(F.size(letters) - (TEXT_K - 1), F.lit(0)) + 1, TEXT_K - 1), after)
            found = F.concat(F.col(anchors), _let(both, lambda c: _anchors(c, TEXT_K, TEXT_S, F.col(over))))
            return _or_whole(found, F.concat(F.col(letters), after))
        return _smallest(_let(characters(tail), of))

    return out.withColumns({name: made(tail) for name, tail in tails.items()}).drop(letters, anchors, over)


def fingerprint(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda a: F.hex(a)), "-")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: share of the ``ANCHORS`` smallest hashes of both that match at consistent positions.

    Two fingerprints without anchors are alike (1); one without is unlike any other (0).
    """
    def hashes(x):
        return F.transform(x, lambda v: F.shiftright(v, POSITION_BITS))

    def place(v):
        return v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long"))

    def consistent(d):
        slack = F.greatest(F.lit(32).cast("long"), F.floor(F.array_max(F.transform(a, place)) / 8))
        return _let(F.get(F.sort_array(d), F.floor(F.size(d) / 2).cast("int")), lambda middle: _let(
            slack, lambda most: F.size(F.filter(d, lambda x: F.abs(x - middle) <= most))))

    def score(ha, hb):
        def of(union):
            shifts = F.transform(F.array_intersect(union, F.array_intersect(ha, hb)), lambda h: (
                place(F.get(a, (F.array_position(ha, h) - 1).cast("int")))
                - place(F.get(b, (F.array_position(hb, h) - 1).cast("int")))))
            matched = _let(shifts, lambda d: F.when(F.size(d) == 0, 0).otherwise(consistent(d)))
            return F.when(F.size(union) == 0, 1.0).otherwise(matched / F.size(union))

        return _let(F.slice(F.sort_array(F.array_union(ha, hb)), 1, ANCHORS), of)

    return _let(hashes(a), lambda ha: _let(hashes(b), lambda hb: score(ha, hb)))


def _bucket(ids: Column, knots: list[int], parts: int) -> Column:
    """Order-preserving bucket number: the knot interval, found by halving, cut evenly; null is first."""
    def interval(lo: int, hi: int) -> Column:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            return F.when(ids < F.lit(knots[mid]), interval(lo, mid)).otherwise(interval(mid, hi))
        span = max(1, knots[hi] - knots[lo])
        part = F.floor((ids - F.lit(knots[lo])).cast("double") / span * parts).cast("int")
        return F.lit(lo * parts) + F.greatest(F.lit(0), F.least(part, F.lit(parts - 1)))

    return F.when(ids.isNull(), F.lit(0)).otherwise(interval(0, len(knots) - 1))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Rows of ``docs`` dealt into buckets of neighbouring ids, with what follows them at hand.

    Returns the rows with the working columns (bucket, copy flag, order) by which a window finds the
    next row: the first rows of each bucket are copied behind the bucket before, those of the first
    bucket behind the last one.
    """
    bucket, target, copied, first, before = (free_name(docs, c) for c in (
        "bucket", "target", "copied", "first_id", "bucket_before"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"),
                     F.percentile_approx(id_col, [i / KNOTS for i in range(1, KNOTS)], 10_000).alias("cuts")).first()
    knots = sorted({stats["lo"] or 0, *(stats["cuts"] or []), (stats["hi"] or 0) + 1})
    parts = max(1, min(stats["n"] // BUCKET_ROWS, MAX_BUCKETS) // max(1, len(knots) - 1))
    dealt = docs.withColumn(bucket, _bucket(F.col(id_col), knots, parts))
    firsts = (dealt.groupBy(bucket).agg(F.min(F.struct(id_col)).getField(id_col).alias(first)))
    order = Window.orderBy(bucket)
    last = Window.orderBy(F.desc(bucket))
    firsts = firsts.select(F.col(bucket).alias(f"{bucket}_"), first, F.coalesce(
        F.lag(bucket).over(order), F.first(bucket).over(last)).alias(before))
    marked = dealt.join(F.broadcast(firsts), (F.col(bucket) == F.col(f"{bucket}_"))
                        & F.col(id_col).eqNullSafe(F.col(first)), "left")
    rows = marked.withColumn(target, F.explode(F.when(F.col(before).isNull(), F.array(
        F.struct(F.col(bucket).alias("b"), F.lit(False).alias("c")))).otherwise(F.array(
            F.struct(F.col(bucket).alias("b"), F.lit(False).alias("c")),
            F.struct(F.col(before).alias("b"), F.lit(True).alias("c"))))))
    rows = rows.select(*docs.columns, F.col(target)["b"].alias(bucket), F.col(target)["c"].alias(copied))
    return rows, (bucket, copied)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``fingerprint`` string of the whole text.

    A null text counts as empty; a text without a symbol has the empty fingerprint; a text without
    a syncmer, as all below ``TEXT_K`` symbols, has one anchor, its whole symbol list.  Equal texts have equal fingerprints; repeated
    rows stay; an empty table gives an empty one; an input column named fingerprint is replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, "fingerprint")]
    return docs.select(*keep, fingerprint(sketch(docs[text_col])).alias("fingerprint"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last quarter of the code points replaced by the first as many of the next
    row's text, in (doc_id, text) order, the first row following the last.  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts are empty, null
    ids come first, repeated ids follow one another by text; a single row is its own next.
    """
    rows, (bucket, copied) = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
                                       "doc_id", "text")
    order = Window.partitionBy(bucket).orderBy(copied, "doc_id", "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    following = rows.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    cut = following.select("*", n.cast("long").alias("n_chars"), F.substring(F.col("text"), F.lit(1), n - quarter).alias("head"),
                           F.substring(F.col("text"), n - quarter + 1, quarter).alias("tail"),
                           F.substring(F.col("next_text"), F.lit(1), quarter).alias("new_tail")).drop("next_text")
    cut = cut.withColumn("edited_sha256", F.sha2(F.concat("head", "new_tail"), 256))
    made = sketches(cut, "head", {"own": F.col("tail"), "changed": F.col("new_tail")}).drop("head", "tail", "new_tail")
    made = made.withColumn("following", F.lead("own").over(order)).where(~F.col(copied))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
