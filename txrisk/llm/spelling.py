"""Spelling variants by dynamic programming over a sorted vocabulary.

Two words are near if one inserted, deleted or replaced code point makes them equal.
Such a pair shares its first or its last ``SHARED`` code points whenever both words
have at least ``2 * SHARED + 1``: the one edit lies in one half only. So the vocabulary
is sorted twice, by the words and by the words reversed, and every word is held
against the sorted range that starts like it.

Within a range the scan goes down the sorted list one code point at a time. Words that
share a prefix (known from the longest common prefixes of neighbours) share the row of
the edit matrix at that depth, of which only the band of width 3 matters; a row is
computed once per query and run of words, and a run whose row exceeds one edit
everywhere is skipped with all words in it. The rows of all queries of a batch are
held in arrays and advance together.

Ranges are cut into pieces of at most ``PIECE`` words where the sort puts a border. A
range in one piece is done where it lies. Ranges of several pieces are written, their
pieces are paired by start (after pairs whose shared prefixes already differ by more
than one edit are skipped), and each pair is scanned in a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import frees_memory, store

SHARED = 3
MIN_LENGTH = 2 * SHARED + 1
#: Words of a piece: the most that one task compares with each other at once.
PIECE = 8192
#: A form is this many times as frequent as its variant.
RATIO = 10
RUN = r"[A-Za-zÀ-ÿ]"


# --------------------------------------------------------------------------- vocabulary

def mistyped(doc_id: Column, word: Column, every: int = 31) -> Column:
    """``word``, or the word without one code point if ``every`` divides the CRC-32 of
    "doc_id:word" (a null doc_id is empty): known misspellings for trials."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(
        F.substr(word, F.lit(1), at), F.substr(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = 2,
               every: int | None = None) -> DataFrame:
    """(word string, n long): the maximal runs of letters (ASCII and U+00C0 to U+00FF)
    of whole texts, A-Z lower-cased, of at least ``min_length`` code points and
    ``min_count`` occurrences. With ``every``, some are ``mistyped`` first. Null and
    empty texts have none; repeated rows count each time. Counts are combined before
    the shuffle, so a frequent word is one row per task."""
    upper = "".join(map(chr, range(65, 91)))
    # runs below min_length cannot reach it: deletion only shortens
    runs = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0)))
    w = docs.select(F.col("doc_id").alias("_id"), runs.alias("_run"))
    w = w.select("_id", F.translate("_run", upper, upper.lower()).alias("_run"))
    word = mistyped(F.col("_id"), F.col("_run"), every) if every else F.col("_run")
    w = w.select(word.alias("word")).where(F.length("word") >= min_length)
    return w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# --------------------------------------------------------------------------- the scan

def _codes(words):
    """(code points of all words, start of each word, length of each word)."""
    import numpy as np
    text = "".join(words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(length) - length, length


def _at(codes, start, length, word, depth):
    """Code point of each word at a depth, 0 outside of it."""
    import numpy as np
    inside = (depth >= 0) & (depth < length[word])
    return np.where(inside, codes[np.minimum(start[word] + np.maximum(depth, 0), len(codes) - 1)], 0)


def common_prefixes(codes, start, length, a, b):
    """Length of the common prefix of each two words."""
    import numpy as np
    out = np.zeros(len(a), np.int64)
    live, depth = np.arange(len(a)), 0
    while len(live):
        x, y = a[live], b[live]
        same = (_at(codes, start, length, x, depth) == _at(codes, start, length, y, depth)) \
            & (depth < length[x]) & (depth < length[y])
        live = live[same]
        out[live] += 1
        depth += 1
    return out


def near_pairs(words, queries, low, high, depth, shared=None):
    """Pairs (query, word) at edit distance one, as indices into ``words``.

    ``words``: a list in which each range [low, high) is sorted by code points;
    ``queries[i]`` is held against the range [low[i], high[i]), whose words share
    their first ``depth`` code points with it; it is not in that range itself.
    """
    import numpy as np
    codes, start, length = _codes(words)
    n = len(words)
    if shared is None:
        at = np.arange(n)
        shared = common_prefixes(codes, start, length, np.maximum(at - 1, 0), at)
    order = np.argsort(shared, kind="stable")      # words by the depth at which runs end there
    ends = np.sort(shared)
    q, lo, hi = (np.asarray(x, np.int64) for x in (queries, low, high))
    q, lo, hi = (x[lo < hi] for x in (q, lo, hi))
    # band of the row: distances of the query's first depth - 1, depth, depth + 1 code points
    band = np.tile(np.array([1, 0, 1], np.int8), (len(q), 1))
    found_q, found_w = [], []
    d, far, cuts = depth, np.int8(2), np.zeros(0, np.int64)
    while len(q):
        # a run of words splits where neighbours share d code points or fewer
        if (n_cuts := np.searchsorted(ends, d, "right")) != len(cuts):
            cuts = np.sort(order[:n_cuts])
        first, last = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "left")
        parts = last - first + 1
        i = np.repeat(np.arange(len(q)), parts)
        k = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
        cut = first[i] + k
        new_lo = np.where(k == 0, lo[i], cuts[np.maximum(cut - 1, 0)] if len(cuts) else 0)
        new_hi = np.where(k == parts[i] - 1, hi[i], cuts[np.minimum(cut, len(cuts) - 1)] if len(cuts) else 0)
        q, lo, hi, band = q[i], new_lo, new_hi, band[i]
        ended = length[lo] == d          # the first of a run may end here; equal words are one
        if ended.any():
            gap = length[q] - d          # what is left of the query: -1, 0 or 1 code points
            cell = np.where(np.abs(gap) <= 1, band[np.arange(len(q)), np.clip(gap + 1, 0, 2)], far)
            hit = ended & (cell == 1)
            found_q.append(q[hit])
            found_w.append(lo[hit])
            go = ~ended
            q, lo, hi, band = q[go], lo[go], hi[go], band[go]
        c = _at(codes, start, length, lo, d)
        row = np.full((len(q), 3), far, np.int8)
        for j in range(3):               # the query's first d + 1 + (j - 1) code points
            pos = d + j - 1
            same = _at(codes, start, length, q, pos) == c
            best = band[:, j] + np.where(same, 0, 1).astype(np.int8)
            if j < 2:
                best = np.minimum(best, band[:, j + 1] + 1)
            if j > 0:
                best = np.minimum(best, row[:, j - 1] + 1)
            row[:, j] = np.where((pos < 0) | (pos >= length[q]), far, np.minimum(best, far))
        d += 1
        go = row.min(axis=1) <= 1        # else the whole run is skipped
        q, lo, hi, band = q[go], lo[go], hi[go], row[go]
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_w)


def _best(words, n, a, b):
    """Per word with a pair: links, and its near word of largest n (ties: smallest)."""
    import numpy as np
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    names, rank = np.unique(v), np.zeros(len(words), np.int64)
    rank[sorted(names, key=words.__getitem__)] = np.arange(len(names))
    order = np.lexsort([rank[v], -n[v], u])
    u, v = u[order], v[order]
    at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    links = np.diff(np.r_[at, len(u)])
    return u[at], links, n[v[at]], v[at]


_FOUND = ("word string, links long, near_n long, near string, way int, head string, id string, "
          "words array<string>, ns array<long>")


def _links(words, n, way, queries, low, high):
    """Rows of _FOUND for the pairs of some queries; in the reversed list, pairs that
    also start alike are left to the other list."""
    import numpy as np
    import pyarrow as pa
    a, b = near_pairs(words, queries, low, high, SHARED)
    if way and len(a):
        new = np.fromiter((words[i][-SHARED:] != words[j][-SHARED:] for i, j in zip(a, b)), bool, len(a))
        a, b = a[new], b[new]
    if not len(a):
        return None
    real = [w[::-1] for w in words] if way else words
    u, links, near_n, near = _best(real, n, a, b)
    return pa.RecordBatch.from_pydict({
        "word": [real[i] for i in u], "links": links, "near_n": near_n, "near": [real[i] for i in near]})


def _row(part, schema):
    """A batch with all columns of _FOUND."""
    import pyarrow as pa
    return pa.RecordBatch.from_arrays(
        [part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(len(part), f.type)
         for f in schema], schema=schema)


def _arrow_schema():
    import pyarrow as pa
    return pa.schema([("word", pa.string()), ("links", pa.int64()), ("near_n", pa.int64()),
                      ("near", pa.string()), ("way", pa.int32()), ("head", pa.string()),
                      ("id", pa.string()), ("words", pa.list_(pa.string())),
                      ("ns", pa.list_(pa.int64()))])


def _scan(piece: int):
    """Over (way, text, n) sorted: links inside the pieces of ranges, and the pieces of
    ranges that have, or may have, others."""
    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        schema, me = _arrow_schema(), uuid.uuid4().hex
        way, words, ns, made = None, [], [], 0

        def heads():
            """First word of each range, and the end of the list."""
            found = [0] if words else []
            found += [i for i in range(1, len(words)) if words[i][:SHARED] != words[i - 1][:SHARED]]
            return [*found, len(words)]

        def done(size, border):
            """Links among the first ``size`` words; ranges [lo, hi) in ``border`` are kept
            as pieces, too."""
            nonlocal made
            at = [x for x in heads() if x < size] + [size]
            end = np.repeat(at[1:], np.diff(at))
            q = np.arange(size)
            part = _links(words[:size], np.array(ns[:size], np.int64), way, q, q + 1, end)
            if part is not None:
                yield _row(part, schema)
            for lo, hi in border:
                made += 1
                yield _row(pa.RecordBatch.from_pydict({
                    "way": pa.array([way], pa.int32()), "head": [words[lo][:SHARED]],
                    "id": [f"{me}-{made:09d}"], "words": [words[lo:hi]], "ns": [ns[lo:hi]]}), schema)
            del words[:size], ns[:size]

        first = True              # the first range of a partition may have begun in another
        for batch in batches:
            for w, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if w != way and words:
                    at = heads()
                    yield from done(len(words), {(0, at[1])} if first else ())
                    first = False
                way = w
                words.append(t)
                ns.append(n)
                if len(words) >= piece:
                    at = heads()
                    if len(at) > 2:       # all but the range that is still open
                        yield from done(at[-2], {(0, at[1])} if first else ())
                        first = False
                    else:                 # a piece of a long range: its other pieces come
                        yield from done(len(words), {(0, len(words))})
                        first = True
        if words:
            at = heads()
            yield from done(len(words), {(at[-2], at[-1])} | ({(0, at[1])} if first else set()))

    return frees_memory(run)


def _scan_pairs():
    """Over (way, words, ns, other words, other ns): links between two pieces."""
    def run(batches):
        import numpy as np
        schema = _arrow_schema()
        for batch in batches:
            for way, a, m, b, n in zip(*(c.to_pylist() for c in batch.columns)):
                size = np.full(len(a), len(a), np.int64)
                part = _links(a + b, np.array(m + n, np.int64), way, np.arange(len(a)), size, size + len(b))
                if part is not None:
                    yield _row(part, schema)

    return frees_memory(run)


def _start(words: Column) -> Column:
    """What all words of a sorted piece begin with, as far as its first and last do."""
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    same = F.transform(F.sequence(F.lit(1), F.least(F.length(first), F.length(last))),
                       lambda i: F.substr(first, F.lit(1), i) == F.substr(last, F.lit(1), i))
    return F.substr(first, F.lit(1), F.size(F.filter(same, lambda x: x)))


def near_words(vocab: DataFrame, piece: int = PIECE) -> DataFrame:
    """(word, n_near long, near string, near_n long) of every word of ``vocab`` (word,
    n; distinct words of at least MIN_LENGTH code points) that has a near one: how
    many, and the most frequent of them (ties: the smallest by code points)."""
    both = vocab.select(F.lit(0).alias("way"), F.col("word").alias("text"), "n").unionByName(
        vocab.select(F.lit(1).alias("way"), F.reverse("word").alias("text"), "n"))
    # words are few bytes and much work: tasks by their number, not by their size
    tasks = max(1, -(-both.count() // (8 * piece)))
    found = both.repartitionByRange(tasks, "way", "text").sortWithinPartitions("way", "text").mapInArrow(
        _scan(piece), _FOUND)
    found = store(found, "near-words")
    pieces = found.where(F.col("word").isNull())
    heads = store(pieces.select("way", "head", "id", _start(F.col("words")).alias("start")), "near-pieces")
    a, b = (heads.select("way", "head", F.col("id").alias(x), F.col("start").alias(f"{x}_start"))
            for x in ("a", "b"))
    size = F.least(F.length("a_start"), F.length("b_start"))
    # one edit between two words is at most two between equally long beginnings
    pairs = a.join(b, ["way", "head"]).where((F.col("a") < F.col("b")) & (F.levenshtein(
        F.substr("a_start", F.lit(1), size), F.substr("b_start", F.lit(1), size)) <= 2))
    sides = [pieces.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"),
                           F.col("ns").alias(f"{x}_ns")) for x in ("a", "b")]
    pairs = pairs.select("way", "a", "b").join(sides[0], "a").join(sides[1], "b").select(
        "way", "a_words", "a_ns", "b_words", "b_ns")
    links = found.where(F.col("word").isNotNull()).unionByName(
        pairs.repartition(F.col("a_words"), F.col("b_words")).mapInArrow(_scan_pairs(), _FOUND))
    return links.groupBy("word").agg(
        F.sum("links").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("_best")).select(
        "word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.n")).alias("near_n"))


# --------------------------------------------------------------------------- groups

def variant_groups(vocab: DataFrame, ratio: int = RATIO, piece: int = PIECE) -> DataFrame:
    """word, n, n_near (near words), form (the most frequent near word, if ``ratio``
    times as frequent as the word; else null), form_n (its n or null) and root (the
    last word of the chain of forms; the word itself without a form).

    A chain's counts grow by ``ratio`` at each step, so it has as many steps as the
    largest count has digits; roots are found by doubling over the words that have a
    form.
    """
    vocab = store(vocab.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = near_words(vocab, piece)
    is_form = F.col("near_n") >= ratio * F.col("n")
    words = store(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")),
        "spelling-forms")
    chain = words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most, reach = vocab.agg(F.max("n")).first()[0] or 0, 1
    steps = len(str(most)) if ratio >= 10 else most.bit_length()
    while reach < steps:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        chain = store(chain.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
        reach *= 2
    return words.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
