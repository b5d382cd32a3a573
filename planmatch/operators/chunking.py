"""Documents into chunks, each document inside its own row.

A document is one row, so its sentences, distances and chunks are array
expressions of that row: nothing is shuffled, and a very long document is no more
than a long row. Explode comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.functions.text import BLANKS, sentences, tokens
from planmatch.functions.vectors import cosine
from planmatch.operators.joins import join_back

# Pieces of sentences whose chunks are gathered before they join those of the document.
PIECES_AT_ONCE = 1_000


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The one-element explode keeps Catalyst from copying an expensive array
    expression into every use, which inside a lambda would mean once per element.
    """
    wrapped = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(wrapped))


def static_windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens, neighbours sharing `overlap`; at least one window."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.greatest(F.ceil((F.size(words) - overlap) / F.lit(step)).cast("int"), F.lit(1)) - 1
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size))
    )


def chunk_static(
    docs: DataFrame, size: int = 512, overlap: int = 20, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, chunk_no, n_tokens, chunk_text) with fixed token windows."""
    pinned = pin(docs.select(named(doc), named(text)), words=tokens(named(text)))
    windows = F.transform(
        static_windows(F.col("words"), size, overlap),
        lambda w: F.struct(F.size(w).alias("n_tokens"), F.concat_ws(" ", w).alias("chunk_text")),
    )
    return _exploded(pinned, windows, [doc])


def sentence_pieces(text: Column, size: int) -> Column:
    """(n, words) of every sentence with a word, in order; a sentence of more than `size`
    words comes in pieces of `size`."""
    words = F.filter(F.transform(sentences(text), tokens), lambda w: F.size(w) > 0)
    pieces = F.flatten(F.transform(words, lambda w: static_windows(w, size, 0)))
    return F.transform(pieces, lambda w: F.struct(F.size(w).alias("n"), F.concat_ws(" ", w).alias("words")))


def _filled(pieces: Column, size: int, overlap: int) -> Column:
    """Chunks as arrays of pieces: each takes what fits, the next begins with the last
    pieces of the one before.

    One fold in order. The state is the open chunk and the closed ones of this stretch;
    stretches of PIECES_AT_ONCE keep the list that a step appends to short.
    """

    def total(held: Column) -> Column:
        return F.aggregate(held, F.lit(0), lambda a, p: a + p["n"])

    def carried(held: Column, room: Column) -> Column:
        """The longest end of `held` with at most `room` words."""
        start = F.struct(F.lit(0).alias("pieces"), F.lit(0).alias("n"))
        taken = F.aggregate(
            F.reverse(held),
            start,
            # Once a piece does not fit, n is beyond the room for all before it.
            lambda a, p: F.struct(
                F.when(a["n"] + p["n"] <= room, a["pieces"] + 1).otherwise(a["pieces"]).alias("pieces"),
                (a["n"] + p["n"]).alias("n"),
            ),
        )["pieces"]
        return F.slice(held, F.size(held) - taken + 1, taken)

    def step(state: Column, piece: Column) -> Column:
        fits = total(state["held"]) + piece["n"] <= size
        room = F.least(F.lit(overlap), size - piece["n"])
        kept = F.when(fits, state["held"]).otherwise(carried(state["held"], room))
        return F.struct(
            F.when(fits, state["closed"]).otherwise(F.concat(state["closed"], F.array(state["held"]))).alias("closed"),
            F.concat(kept, F.array(piece)).alias("held"),
        )

    def stretch(state: Column, pieces: Column) -> Column:
        begin = F.struct(none_closed.alias("closed"), state["held"].alias("held"))
        now = F.aggregate(pieces, begin, step)
        return F.struct(
            F.concat(state["closed"], F.array(now["closed"])).alias("closed"), now["held"].alias("held")
        )

    piece = "struct<n:int,words:string>"
    none_closed = F.array().cast(f"array<array<{piece}>>")
    begin = F.struct(
        F.array().cast(f"array<array<array<{piece}>>>").alias("closed"), F.array().cast(f"array<{piece}>").alias("held")
    )
    stretches = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(pieces) / F.lit(PIECES_AT_ONCE)).cast("int")),
        lambda i: F.slice(pieces, i * PIECES_AT_ONCE + 1, F.lit(PIECES_AT_ONCE)),
    )
    return F.aggregate(
        stretches, begin, stretch, lambda s: F.concat(F.flatten(s["closed"]), F.array(s["held"]))
    )


def chunk_sentences(
    docs: DataFrame, size: int = 512, overlap: int = 20, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, chunk_no, n_tokens, chunk_text): whole sentences up to `size` tokens.

    A chunk begins with the last sentences of the one before, as many as have at most
    `overlap` tokens together and leave room for the next sentence. Only a sentence of
    more than `size` tokens is cut. A text without words is one empty chunk, a null text
    has none; words are put together with single blanks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    pinned = pin(docs.select(named(doc), named(text)), _pieces=sentence_pieces(named(text), size))
    pinned = pin(pinned, _chunks=_filled(F.col("_pieces"), size, overlap))
    chunks = F.transform(
        "_chunks",
        lambda c: F.struct(
            F.aggregate(c, F.lit(0), lambda a, p: a + p["n"]).alias("n_tokens"),
            F.array_join(F.transform(c, lambda p: p["words"]), " ").alias("chunk_text"),
        ),
    )
    return _exploded(pinned, chunks, [doc])


def jaccard_distances(groups: Column) -> Column:
    """1 - Jaccard of neighbouring word sets; two empty sets are alike."""
    sizes = _between_neighbours(
        groups,
        lambda a, b: F.struct(
            F.size(F.array_intersect(a, b)).alias("common"), (F.size(a) + F.size(b)).alias("both")
        ),
    )
    return F.transform(
        sizes,
        lambda s: F.when(
            s["both"] > 0, 1 - s["common"] / (s["both"] - s["common"])
        ).otherwise(F.lit(0.0)),
    )


def cosine_distances(vectors: Column) -> Column:
    return _between_neighbours(
        vectors, lambda a, b: 1 - F.coalesce(cosine(a, b), F.lit(0.0))
    )


def _between_neighbours(items: Column, distance) -> Column:
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), distance)


def sentence_words(parts: Column) -> Column:
    """Per sentence its distinct lower-case words."""
    return F.transform(
        parts, lambda s: F.array_distinct(F.filter(F.split(F.lower(s), BLANKS), lambda t: t != ""))
    )


def word_groups(words: Column, buffer: int) -> Column:
    """Per sentence the distinct words of it and `buffer` neighbours each way."""
    if buffer == 0:
        return words

    def around(i: Column) -> Column:
        first = F.greatest(i - buffer, F.lit(1))
        return F.array_distinct(F.flatten(F.slice(words, first, i + buffer - first + 1)))

    places = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(places, around)).otherwise(words)


def interpolated(values: Column, p: float) -> Column:
    """Quantile of a sorted array, linear between neighbours."""
    place = F.lit(float(p)) * (F.size(values) - 1)
    low = F.get(values, F.floor(place).cast("int"))
    high = F.get(values, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def with_semantic_chunks(
    docs: DataFrame,
    percentile: float = 95.0,
    buffer: int = 1,
    text: str = "text",
    vectors: str | None = None,
) -> DataFrame:
    """Add `chunks` (array of texts): a cut wherever the distance between neighbouring
    sentences exceeds the document's own percentile.

    Distance is 1 - Jaccard of buffered word sets, or 1 - cosine of a column of
    sentence vectors (one per sentence, already buffered by their producer).
    """
    pinned = pin(docs, _parts=sentences(named(text)))
    if vectors is None:
        pinned = pin(pinned, _words=sentence_words(F.col("_parts")))
        pinned = pin(pinned, _groups=word_groups(F.col("_words"), buffer))
        distances = jaccard_distances(F.col("_groups"))
    else:
        distances = cosine_distances(named(vectors))
    pinned = pin(pinned, _dist=distances)
    pinned = pin(pinned, _sorted=F.sort_array("_dist"))
    pinned = pin(pinned, _cut=interpolated(F.col("_sorted"), percentile / 100.0))
    # A cut after sentence i starts a chunk at sentence i+1.
    n = F.size("_parts")
    starts = F.filter(
        F.zip_with(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            F.concat(F.array(F.lit(None).cast("double")), "_dist"),
            lambda i, d: F.when(d.isNull() | (d > F.col("_cut")), i),
        ),
        lambda i: i.isNotNull(),
    )
    pinned = pin(pinned, _starts=starts)
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(n + 1))
    chunks = F.zip_with(
        "_starts",
        ends,
        lambda a, b: F.concat_ws("", F.slice(F.col("_parts"), a, b - a)),
    )
    return pin(pinned, chunks=chunks).select(*[named(c) for c in docs.columns], "chunks")


def _sized(chunks: Column) -> Column:
    return F.transform(
        chunks,
        lambda c: F.struct(F.size(tokens(c)).alias("n_tokens"), c.alias("chunk_text")),
    )


def _exploded(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    kept = [named(c) for c in keep]
    return df.select(*kept, F.posexplode(chunks).alias("chunk_no", "c")).select(
        *kept, "chunk_no", "c.n_tokens", "c.chunk_text"
    )


def chunk_semantic(
    docs: DataFrame,
    percentile: float = 95.0,
    buffer: int = 1,
    doc: str = "doc_id",
    text: str = "text",
    vectors: str | None = None,
) -> DataFrame:
    """(doc, chunk_no, n_tokens, chunk_text) cut where the topic changes."""
    columns = [named(c) for c in (doc, text, vectors) if c]
    chunked = with_semantic_chunks(docs.select(*columns), percentile, buffer, text, vectors)
    return _exploded(chunked, _sized(F.col("chunks")), [doc])


def chunk_guarded(
    docs: DataFrame,
    limit: int,
    percentile: float = 95.0,
    buffer: int = 1,
    overlap: int = 20,
    batch: str | None = None,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Semantic chunks, unless one has more than `limit` tokens: then fixed windows
    of `limit` tokens from the original text.

    With `batch` the test covers a whole batch (one oversized chunk re-chunks all
    its documents); without, each document stands for itself and nothing moves.
    """
    docs = docs.select(*[named(c) for c in dict.fromkeys((doc, text, *([batch] if batch else [])))])

    def largest(sized: str) -> Column:
        return F.array_max(F.transform(sized, lambda c: c["n_tokens"]))

    if batch is None:
        flagged = docs.withColumn("_batch_over", F.lit(False))
        own_verdict = F.lit(True)
    else:
        # Only a text beyond the limit can have a chunk beyond it.
        long = docs.where(named(batch).isNotNull() & (F.size(tokens(named(text))) > limit))
        sized = with_semantic_chunks(long, percentile, buffer, text)
        sized = pin(sized, _sized=_sized(F.col("chunks")))
        over = sized.where(largest("_sized") > limit).select(named(batch)).distinct()
        sizes = docs.groupBy(named(batch)).agg(F.count(F.lit(1)).alias("n"))
        verdicts = sizes.join(over, batch).withColumn("_batch_over", F.lit(True))
        flagged = join_back(docs, verdicts, [batch], [doc]).withColumn(
            "_batch_over", F.coalesce("_batch_over", F.lit(False))
        )
        # Documents without a batch stand for themselves.
        own_verdict = named(batch).isNull()
    # Texts of a re-chunked batch need no second look.
    kept = F.when(~F.col("_batch_over"), named(text))
    chunked = with_semantic_chunks(flagged.withColumn("_kept", kept), percentile, buffer, "_kept")
    chunked = pin(chunked, _sized=_sized(F.col("chunks"))).drop("chunks")
    over = F.col("_batch_over") | (own_verdict & (F.coalesce(largest("_sized"), F.lit(0)) > limit))
    chunked = pin(chunked, _over=over)
    chunked = pin(chunked, _tokens=F.when(F.col("_over"), tokens(named(text))))
    windows = F.transform(
        static_windows(F.col("_tokens"), limit, overlap),
        lambda w: F.struct(F.size(w).alias("n_tokens"), F.concat_ws(" ", w).alias("chunk_text")),
    )
    chosen = F.when(F.col("_over"), windows).otherwise(F.col("_sized"))
    return _exploded(chunked, chosen, [doc])
