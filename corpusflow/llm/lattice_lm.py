"""LM scoring by subword lattices.

A word, behind a word mark, is spelt by the pieces of an existing vocabulary; every way to spell it is a path of a
lattice, and the word's probability is the sum over all paths of the product of their pieces' probabilities.  A
forward recursion over byte positions gives it in log space.  No piece crosses a word's start, so a text's marginal
probability is the product over its words, and one more factor for its end.

The vocabulary's own scores start the pieces' probabilities; they are then fitted to the training documents by
expected piece counts (forward and backward recursion) over all distinct words.  Nothing but these counts, one number
a piece, comes to the driver.

A word of the training documents has one more path, an arc over the whole word: by absolute discounting it takes
(count - discount) / tokens, and what the discounts leave goes to the spellings, so that all words together keep a
probability of 1.  Arcs are counted for each of a few latent classes of documents (languages, in effect), with the
arcs of all documents below them; a text's probability is the sum over the classes.  Within a text, a word that has
occurred gains weight (Polya urn), which again keeps the sum over all words at 1.

The classes are fitted to all training documents, as bags of hashed words, by rounds that give each document to its
best class and count the classes' words anew: a pass over the blocks each, of which classes x 2^13 sums come back.  A bounded sample (``most_fitted`` documents) gives their
start alone; in each of the first rounds the document of all that they explain worst starts one more class, so a language
that the sample has missed gets its own.  Every count is over all training documents, too.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, batches_of, blocks, by_block, hashed_words, learn_remainder, mix64, rows_of, split_words, text_chunks, written

PARTS, HELD_OUT = 5, 1
FITS = 3  # rounds of expected counts
CLASSES, MOST_FITTED, BAG_BITS = 8, 1000, 13
MORE_CLASSES, ROUNDS = 2, 3  # classes added on the way, passes over all training documents
LEAST_WORDS = 20  # of a document that starts a class
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20  # of the corpus for one bucket of words
URN = 2000.0  # words that a text's own words are weighed against
PRIOR = 0.5  # added to each piece's expected count
WIDE = 48  # words of up to so many bytes go through the recursion together
MARK = b" "  # the word mark, one byte here
_STEP = np.uint64(0x100000001B3)


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """(pieces, start log probabilities) of a sentencepiece vocabulary: its scores, softened to ranks; all 256 bytes are in it."""
    import public_tokenizers
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    scores: dict[bytes, float] = {}
    for i in range(held.get_piece_size()):
        if held.is_control(i) or held.is_unknown(i):
            continue
        name = held.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if held.is_byte(i) else name.replace("▁", " ").encode()
        if piece == piece.lower() and MARK not in piece[1:] and piece not in scores:
            scores[piece] = 1.0 / (10.0 - held.get_score(i))  # scores are negative ranks
    for b in range(256):
        scores.setdefault(bytes([b]), 1e-6)
    pieces = sorted(scores)
    start = np.array([scores[p] for p in pieces])
    return pieces, np.log(start / start.sum())


class Lattice:
    """The pieces' hash table and the recursions.  logp: natural log probabilities of the pieces."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self._index = None

    def __getstate__(self):
        return self.pieces, self.logp

    def __setstate__(self, state):
        self.__init__(*state)

    def _build(self) -> None:
        self._index = {p: i for i, p in enumerate(self.pieces)}
        self._lengths = sorted({len(p) for p in self.pieces})
        self._sizes = set(self._lengths)
        keys = np.array([_hash(p) for p in self.pieces], np.uint64)
        self._keys = keys
        # level 1: a table in which each piece has its own place, or else goes to level 2
        place = (keys >> np.uint64(44)).astype(np.int64)
        self._one = np.full(1 << 20, -1, np.int32)
        self._one[place] = np.arange(len(keys))
        left = np.flatnonzero(self._one[place] != np.arange(len(keys)))
        self._seed = np.uint64(1)
        while True:
            place = (mix64(keys[left] * self._seed) >> np.uint64(46)).astype(np.int64)
            if len(np.unique(place)) == len(left):
                break
            self._seed += np.uint64(2)
        self._two = np.full(1 << 18, -1, np.int32)
        self._two[place] = left

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, -1 if there is none."""
        one = self._one[(keys >> np.uint64(44)).astype(np.int64)]
        found = np.where((one >= 0) & (self._keys[one] == keys), one, -1)
        miss = np.flatnonzero(found < 0)
        two = self._two[(mix64(keys[miss] * self._seed) >> np.uint64(46)).astype(np.int64)]
        found[miss] = np.where((two >= 0) & (self._keys[two] == keys[miss]), two, -1)
        return found

    def _arcs(self, letters: np.ndarray):
        """arcs[end]: (start, piece of each word or -1), for words of one length (rows of bytes)."""
        n, width = letters.shape
        letters = letters.astype(np.uint64) + np.uint64(1)
        arcs: list[list] = [[] for _ in range(width + 1)]
        for start in range(width):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(width, start + self._lengths[-1]) + 1):
                h = h * _STEP + letters[:, end - 1]
                if end - start in self._sizes:
                    found = self._find(mix64(h * GOLDEN + np.uint64(end - start)))
                    if (found >= 0).any():
                        arcs[end].append((start, found))
        return arcs

    def words(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(natural log probability of all spellings of each marked word, expected piece counts weighted by ``counts``)."""
        if self._index is None:
            self._build()
        out = np.zeros(len(words))
        expected = np.zeros(len(self.pieces))
        lengths = np.array([len(w) for w in words])
        for width in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == width)
            if width > WIDE:
                for i in at.tolist():
                    out[i] = self._long(words[i], 0 if counts is None else counts[i], expected)
                continue
            for k in range(0, len(at), 20_000):
                some = at[k:k + 20_000]
                letters = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8).reshape(-1, width)
                out[some] = self._equal(letters, None if counts is None else counts[some], expected)
        return out, expected

    def _equal(self, letters, counts, expected):
        n, width = letters.shape
        arcs = self._arcs(letters)
        table = np.append(self.logp, -np.inf)  # -1: no piece
        forward = np.full((width + 1, n), -np.inf)
        forward[0] = 0.0
        for end in range(1, width + 1):
            terms = np.stack([forward[start] + table[found] for start, found in arcs[end]])
            top = terms.max(0)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                forward[end] = np.log(np.exp(terms - top).sum(0)) + top
        if counts is not None and len(counts):
            backward = np.full((width + 1, n), -np.inf)
            backward[width] = 0.0
            for end in range(width, 0, -1):
                for start, found in arcs[end]:
                    through = backward[end] + table[found]
                    hit = np.flatnonzero(found >= 0)
                    backward[start][hit] = np.logaddexp(backward[start][hit], through[hit])
                    share = np.exp(forward[start][hit] + through[hit] - forward[width][hit]) * counts[hit]
                    expected += np.bincount(found[hit], weights=share, minlength=len(expected))
        return forward[width]

    def _long(self, word: bytes, count: float, expected: np.ndarray) -> float:
        """The same recursions for one long word."""
        n, arcs = len(word), []
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for end in range(1, n + 1):
            here = []
            for size in self._lengths:
                if size > end:
                    break
                piece = self._index.get(word[end - size:end])
                if piece is not None:
                    here.append((end - size, piece, forward[end - size] + self.logp[piece]))
            top = max(x for _, _, x in here)
            forward[end] = top + math.log(sum(math.exp(x - top) for _, _, x in here))
            arcs.append(here)
        if count:
            backward = [-math.inf] * n + [0.0]
            for end in range(n, 0, -1):
                for start, piece, _ in arcs[end - 1]:
                    through = backward[end] + self.logp[piece]
                    top = max(backward[start], through)
                    backward[start] = top + math.log(math.exp(backward[start] - top) + math.exp(through - top))
                    expected[piece] += count * math.exp(forward[start] + through - forward[n])
        return forward[n]


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_STEP) + b + 1) % (1 << 64)
    return int(mix64(np.array([h], np.uint64) * GOLDEN + np.uint64(len(piece)))[0])


END = b""  # the end of a text, among the words


def bag(text: bytes) -> np.ndarray:
    """Counts of the text's words by hash."""
    words = hashed_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    return np.bincount((words >> np.uint64(64 - BAG_BITS)).astype(np.int64), minlength=1 << BAG_BITS)


def class_fits(by_word: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words, number of words of each text, log probability of each text by each class) of some texts; ``by_word``: a row a hashed word."""
    hashes, counts, _ = hashed_words(data, offsets)
    at = (hashes >> np.uint64(64 - BAG_BITS)).astype(np.int64)
    fit = np.zeros((len(counts), by_word.shape[1]), by_word.dtype)
    some = counts > 0
    if len(at):
        fit[some] = np.add.reduceat(by_word[at], (np.cumsum(counts) - counts)[some], axis=0)
    return at, counts, fit


def fit_classes(bags: np.ndarray, classes: int, rounds: int = 25) -> np.ndarray:
    """Log probabilities of hashed words, a row a class: a mixture of unigrams fitted by expectation and maximisation.

    The start is one document for each class, each as unlike the others as there are; fewer documents give fewer classes.
    """
    if not len(bags):
        return np.zeros((1, 1 << BAG_BITS))
    x = bags.astype(np.float32)
    unit = np.sqrt(x)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    first, nearest = [0], unit @ unit[0]
    while len(first) < min(classes, len(x)):
        first.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[first[-1]])
    share = 30 * (unit @ unit[first].T)
    for _ in range(rounds):
        share = np.exp(share - share.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        words = share.T @ x + 0.1
        words = np.log(words / words.sum(1, keepdims=True))
        share = x @ words.T + np.log(share.mean(0) + 1e-9)
    return words.astype(np.float64)


def document_classes(held: DataFrame, parts: int, held_out: int, classes: int = CLASSES, most_fitted: int = MOST_FITTED,
                     more: int = MORE_CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of hashed words, a row a class: fitted to all training documents, from a start on a sample chosen by a hash."""
    known = held.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts != held_out)
    some = known.select("row").orderBy(F.xxhash64("row"), "row").limit(most_fitted)

    def bags(batches):
        def out():
            for b in batches:
                for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                    n = bag(text)
                    at = np.flatnonzero(n)
                    yield row, at.tolist(), n[at].tolist()

        return batches_of(out(), pa.schema([("row", pa.int64()), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]), 500)

    # the sample's rows, at most most_fitted, are broadcast and collected
    found = held.select("row", "text").join(F.broadcast(some), "row").mapInArrow(bags, "row long, at array<long>, n array<long>").collect()
    x = np.zeros((len(found), 1 << BAG_BITS), np.float32)
    for i, r in enumerate(sorted(found, key=lambda r: r.row)):
        x[i, r.at] = r.n
    words = fit_classes(x, classes)
    share = np.full(len(words), 1 / len(words))
    for i in range(rounds if len(found) else 0):
        words, share = fitted_round(known, words, share, i < more)
    return words


def fitted_round(known: DataFrame, words: np.ndarray, share: np.ndarray, grow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(words, share) after one round over all documents; with ``grow`` the one explained worst, a word, starts another class."""
    kinds, width = words.shape

    start, by_word = np.log(share + 1e-9), np.ascontiguousarray(words.T, np.float32)

    def run(batches):
        sums, docs, worst = np.zeros(kinds * width), np.zeros(kinds), (0.0, -1, None)
        for b in batches:
            rows = b.column("row").to_numpy()
            for first, data, offsets in text_chunks(b.column("text")):
                at, counts, fit = class_fits(by_word, data, offsets)
                best = (fit + start).argmax(1)
                docs += np.bincount(best, minlength=kinds)
                sums += np.bincount(np.repeat(best * width, counts) + at, minlength=kinds * width)
                each = np.where(counts >= LEAST_WORDS, fit.max(1) / np.maximum(counts, 1), 0.0)
                i = int(each.argmin())
                if (found := (float(each[i]), int(rows[first + i]))) < worst[:2]:
                    begin = int(counts[:i].sum())
                    worst = (*found, np.bincount(at[begin:begin + counts[i]], minlength=width))
        cells = np.flatnonzero(sums)
        # cells beyond the sums: the classes' documents
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, kinds * width + np.arange(kinds))), pa.array(np.append(sums[cells], docs)),
                                          *(pa.nulls(len(cells) + kinds, t) for t in (pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], schema=_ROUND)
        if worst[2] is not None:
            at = np.flatnonzero(worst[2])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0.0]), pa.array([worst[0]]), pa.array([worst[1]]), pa.array([at.tolist()], pa.list_(pa.int64())),
                                              pa.array([worst[2][at].tolist()], pa.list_(pa.int64()))], schema=_ROUND)

    found = (known.select("row", "text").mapInArrow(run, "cell long, n double, fit double, row long, at array<long>, times array<long>")
             .groupBy("cell").agg(F.sum("n").alias("n"), F.min(F.struct("fit", "row", "at", "times")).alias("worst"))
             .toArrow())  # a row a cell, classes x 2^BAG_BITS at most
    cells, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    total = np.zeros(kinds * width + kinds)
    total[cells[cells >= 0]] = n[cells >= 0]
    sums, docs = total[:kinds * width].reshape(kinds, width), total[kinds * width:]
    if grow and (cells < 0).any():
        worst = found.column("worst")[int(np.flatnonzero(cells < 0)[0])].as_py()
        more = np.zeros(width)
        more[worst["at"]] = worst["times"]
        sums, docs = np.vstack([sums, more]), np.append(docs, 1.0)
    sums = sums + 0.1
    return np.log(sums / sums.sum(1, keepdims=True)), docs / max(docs.sum(), 1e-9)


_ROUND = pa.schema([("cell", pa.int64()), ("n", pa.float64()), ("fit", pa.float64()), ("row", pa.int64()), ("at", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def counted_words(held: DataFrame, classes: np.ndarray, parts: int, held_out: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row a bucket of words, written: bucket, words, counts (of each word, a number a class), blocks, sizes, places, stats.

    Every distinct word of the corpus, and END, is in one bucket, by its hash.  ``blocks`` are the blocks that hold some of
    the bucket's words, ``sizes`` how many, ``places`` which ones.  Lists of words are joined by newlines, lists of numbers
    packed, so that what moves is a row for each block and bucket.  The number of buckets follows the size of the corpus.
    """
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, kinds = max(1, -(-total // bucket_bytes)), len(classes)
    by_word = np.ascontiguousarray(classes.T, np.float32)

    def run(batches):
        def out():
            for block, ids, texts in by_block(batches):
                index: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
                end, cells = index[END], []
                best = [k for _, data, offsets in text_chunks(pa.array(texts, pa.binary())) for k in class_fits(by_word, data, offsets)[2].argmax(1).tolist()]
                for doc_id, text, kind in zip(ids, texts, best):
                    own = split_words(text)
                    at = np.fromiter(map(index.__getitem__, own), np.int64, len(own))
                    if learn_remainder(doc_id, parts) != held_out:
                        cells.append(np.append(at, end) * kinds + kind)
                counts = np.bincount(np.concatenate(cells) if cells else [], minlength=len(index) * kinds).astype("<i4").reshape(-1, kinds)
                words = list(index)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    yield int(bucket[at[0]]), block, b"\n".join([words[i] for i in at.tolist()]), counts[at].tobytes()

        return batches_of(out(), pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]), 500,
                          weigh=lambda r: len(r[2]) + len(r[3]))

    def merge(key, rows):
        index: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        blocks_ = rows.column("block").to_pylist()
        places = [np.fromiter(map(index.__getitem__, words.split(b"\n")), "<i4") for words in rows.column("words").to_pylist()]
        counts = np.zeros((len(index), kinds), np.int64)
        for at, packed in zip(places, rows.column("counts").to_pylist()):
            counts[at] += np.frombuffer(packed, "<i4").reshape(-1, kinds)  # the words of a row are distinct
        c, end = counts.sum(1), index.get(END)
        stats = [c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum(), *counts.sum(0), *(counts > 0).sum(0),
                 *(counts[end] if end is not None else np.zeros(kinds))]
        return pa.table([[key[0].as_py()], [b"\n".join(index)], [counts.astype("<i8").tobytes()], [blocks_], [[len(x) for x in places]],
                         [b"".join(x.tobytes() for x in places)], [[float(x) for x in stats]]], schema=_BUCKET)

    seen = held.select("block", "doc_id", "text").mapInArrow(run, "bucket long, block long, words binary, counts binary")
    return written(seen.groupBy("bucket").applyInArrow(merge, _BUCKET_DDL), "words")


_BUCKET = pa.schema([("bucket", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("blocks", pa.list_(pa.int64())),
                     ("sizes", pa.list_(pa.int64())), ("places", pa.binary()), ("stats", pa.list_(pa.float64()))])
_BUCKET_DDL = "bucket long, words binary, counts binary, blocks array<long>, sizes array<long>, places binary, stats array<double>"


def expected_counts(words: DataFrame, lattice: Lattice, kinds: int) -> np.ndarray:
    """Expected counts of all pieces over the distinct training words."""
    def run(batches):
        total = np.zeros(len(lattice.pieces))
        for joined, counts in rows_of(batches, "words", "counts"):
            known = np.frombuffer(counts, "<i8").reshape(-1, kinds).any(1).tolist()
            own = [MARK + w for w, c in zip(joined.split(b"\n"), known) if c and w != END]
            total += lattice.words(own, np.ones(len(own)))[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    found = (words.select("words", "counts").mapInArrow(run, "piece long, n double")
             .groupBy("piece").agg(F.sum("n").alias("n")).collect())  # a number a piece of the vocabulary
    total = np.zeros(len(lattice.pieces))
    for r in found:
        total[r.piece] = r.n
    return total


def earlier(at: np.ndarray) -> np.ndarray:
    """How often each value has occurred before its place."""
    order = np.argsort(at, kind="stable")
    run = at[order]
    starts = np.append(True, run[1:] != run[:-1])
    places = np.arange(len(at))
    out = np.empty(len(at))
    out[order] = places - np.maximum.accumulate(np.where(starts, places, 0))
    return out


def log_probability(at: np.ndarray, logp: np.ndarray, prior: np.ndarray, urn: float = URN, top: np.ndarray | None = None) -> float:
    """Natural log probability of the tokens ``at``; ``logp``: a row a word, a column a class; ``top``: each word's largest probability.

    With r earlier occurrences among the i tokens before it, a word has the probability (urn * p + r) / (urn + i).
    """
    own = logp[at]
    plain = prior + own.sum(0, dtype=np.float64)
    rank = earlier(at)
    again = np.flatnonzero(rank)
    r = rank[again] / urn

    def full(k):
        return plain[k] + np.log1p(r * np.exp(-own[again, k].astype(np.float64))).sum()

    # a class can't have more than this, whatever it gives the repeated words; what stays below exp(-60) can't show in the result
    top = np.exp(logp.max(1).astype(np.float64)) if top is None else top
    most = prior + own[rank == 0].sum(0, dtype=np.float64) + np.log(top[at[again]] + r).sum()
    best = int(most.argmax())
    z = [full(best)]
    z = np.array(z + [full(k) for k in np.flatnonzero(most >= z[0] - 60) if k != best])
    return float(z.max() + np.log(np.exp(z - z.max()).sum()) - np.log1p(np.arange(len(at)) / urn).sum())


def score_documents(docs: DataFrame, vocabulary_path: str | None = None, parts: int = PARTS, held_out: int = HELD_OUT, fits: int = FITS,
                    classes: int = CLASSES, most_fitted: int = MOST_FITTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of every row of ``docs``.

    Learns from rows whose crc32(doc_id as text) mod ``parts`` is not ``held_out``.  Tokens are the words, A-Z lower-cased,
    and one end a document.  ``base_score``: log10 probability by word counts, half a count added; ``score``: by the
    lattices with their arcs over whole words, classes and urn; ``lattice_score``: by the lattices of pieces alone.  A null text is empty: its end alone.  Rows with the same doc_id are documents of their own; a null id
    counts as the empty text.  An empty table gives an empty result; other columns are not read.
    """
    held = blocks(docs, block_bytes=BLOCK_BYTES, block_rows=8192)
    groups = document_classes(held, parts, held_out, classes, most_fitted)
    kinds = len(groups)
    words = counted_words(held, groups, parts, held_out)
    stats = np.array([x or 0 for x in words.agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(4 + 3 * kinds))).first()])
    total, types, once, twice = stats[:4]
    class_tokens, class_types, ends = stats[4:].reshape(3, kinds)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    norm = math.log10(total + 0.5 * (types + 1))
    prior = np.log((ends + 1) / (ends + 1).sum())
    pieces, logp = vocabulary(vocabulary_path)
    for _ in range(fits):
        counts = expected_counts(words, Lattice(pieces, logp), kinds) + PRIOR
        logp = np.log(counts / counts.sum())
    lattice = Lattice(pieces, logp)

    def weigh(batches):
        """Each word's probability of its spellings and its counts, to each block that holds it."""
        def out():
            for joined, counts, blocks_, sizes, places in rows_of(batches, "words", "counts", "blocks", "sizes", "places"):
                own = joined.split(b"\n")
                counts = np.frombuffer(counts, "<i8").reshape(-1, kinds)
                spelt = np.log(0.99) + lattice.words([MARK + w for w in own])[0]
                spelt[[i for i, w in enumerate(own) if w == END]] = math.log(0.01)  # an end has no spelling
                places = np.split(np.frombuffer(places, "<i4"), np.cumsum(sizes)[:-1])
                for block, at in zip(blocks_, places):
                    yield block, b"\n".join([own[i] for i in at.tolist()]), counts[at].tobytes(), spelt[at].astype("<f8").tobytes()

        return batches_of(out(), pa.schema([("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("spelt", pa.binary())]), 500,
                          weigh=lambda r: len(r[1]) + len(r[2]) + len(r[3]))

    values = words.select("words", "counts", "blocks", "sizes", "places").mapInArrow(weigh, "block long, words binary, counts binary, spelt binary")

    def score(key, rows, values):
        index = {w: i for i, w in enumerate(w for joined in values.column("words").to_pylist() for w in joined.split(b"\n"))}
        by_class = np.frombuffer(b"".join(values.column("counts").to_pylist()), "<i8").reshape(-1, kinds)
        spelt = np.frombuffer(b"".join(values.column("spelt").to_pylist()), "<f8")
        c = by_class.sum(1)
        every = (np.maximum(c - discount, 0.0) + (discount * types + 1) * np.exp(spelt)) / (total + 1)
        p = (np.maximum(by_class - discount, 0.0) + (discount * class_types + 1) * every[:, None]) / (class_tokens + 1)
        logp, base, out = np.log(np.maximum(p, 1e-300)).astype(np.float32), np.log10(c + 0.5) - norm, []
        top = np.exp(logp.max(1).astype(np.float64))
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            at = np.array([index[w] for w in split_words(text)] + [index[END]], np.int64)
            out.append((doc_id, learn_remainder(doc_id, parts) == held_out, len(at), int((c[at] > 0).sum()), int(total), float(base[at].sum()),
                        log_probability(at, logp, prior, top=top) / math.log(10), float(spelt[at].sum()) / math.log(10)))
        return pa.table([list(x) for x in zip(*out)] or [[]] * 8, schema=pa.schema(
            [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
             ("base_score", pa.float64()), ("score", pa.float64()), ("lattice_score", pa.float64())]))

    return (held.select("block", "doc_id", "text").groupBy("block").cogroup(values.groupBy("block"))
            .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"))
