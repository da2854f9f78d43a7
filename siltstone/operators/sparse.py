"""Sparse retrieval: weighted index text, BM25 statistics and search of many questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions import text as T
from siltstone.operators.fixed import TERM_ALIASES
from siltstone.session import cut

K1, B = 1.5, 0.75
#: Searches whose terms go to the executors at once, chunks and texts scored at once: they bound what a task holds.
BLOCK, ROWS, TEXTS = 32768, 4096, 256
#: Chunks whose terms are sorted at once: their number and a term's hash share 64 bits.
SORTED, BITS = 256, 56
WORD, LETTERS = 1 << (BITS - 1), "abcdefghijklmnopqrstuvwxyz0123456789_-"
#: Per ASCII character an odd number that stands for it in a word's hash, 0 where it is in no word.
VALUES = np.zeros(128, np.uint64)
VALUES[[ord(c) for c in LETTERS]] = np.random.default_rng(17).integers(1, 1 << 63, len(LETTERS), np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15


def index_text() -> Column:
    """Title, category and heading path twice each, then the text."""
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "title", "category", "category", "heading_path", "heading_path", "text")]
    return F.array_join(F.array(*parts), "\n")


def query_terms(question: Column | str) -> Column:
    """The distinct search terms of a question, with the aliases of the words it holds."""
    q = F.col(question) if isinstance(question, str) else question
    low = T.fold(q)
    extra = [F.when(low.contains(key), T.search_tokens(F.lit("\n".join(aliases)))).otherwise(F.array().cast("array<string>")) for key, aliases in TERM_ALIASES.items()]
    return F.array_distinct(F.concat(T.search_tokens(q), *extra))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, dl): how often each term occurs; dl is the length of the whole chunk in terms."""
    tokens = chunks.select("chunk_id", T.search_tokens(index_text()).alias("tokens")).withColumn("dl", F.size("tokens"))
    return tokens.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("chunk_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_statistics(chunks: DataFrame) -> DataFrame:
    """(term, df, idf) over all chunks; chunks without any term count as documents."""
    n = chunks.count()
    df = postings(chunks).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25_scores(questions: DataFrame, chunks: DataFrame, idf_mode: str = "plus_one") -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that hold a term of the question.

    The questions' terms reduce the postings before anything is shuffled; n and the average length are two numbers.
    """
    terms = questions.select("query_id", F.explode(query_terms("question")).alias("term")).distinct()
    tokens = chunks.select("chunk_id", T.search_tokens(index_text()).alias("tokens")).withColumn("dl", F.size("tokens"))
    facts = chunks.select(T.token_count(index_text()).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n, average = facts.n or 0, max(1.0, facts.avgdl or 0.0)
    wanted = terms.select("term").distinct()
    # Only terms of a question go on; they are counted per task before they are shuffled.
    held = tokens.select("chunk_id", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    odds = (n - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weight = F.log(1 + odds) if idf_mode == "plus_one" else F.log(odds)
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    weighed = held.join(df, "term").select("term", "chunk_id", (weight * saturated).alias("part"))
    return terms.join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, modulo 2**64."""
    made = []
    for base in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    return made[0], made[1]


def hashed_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the search tokens of folded texts, as search_tokens makes them.

    A hash has BITS bits: words get a mixed polynomial of their characters, one to three ideographs their code points,
    15 bits each, so that only words can ever be taken for each other.
    """
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    value = VALUES[np.minimum(code, 127)]
    inside = value > 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.flatnonzero(inside & (code != 95) & (code != 45))  # a word begins with a letter or figure
    at = np.searchsorted(first, starts)
    starts, ends, at = starts[at < len(first)], ends[at < len(first)], at[at < len(first)]
    starts = first[at]
    starts, ends = starts[ends - starts >= 2], ends[ends - starts >= 2]
    powers, inverse = _powers(len(code))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers, dtype=np.uint64)])
    word = (sums[ends] - sums[starts]) * inverse[starts]
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        word = (word ^ (word >> np.uint64(33))) * np.uint64(factor)
    word = (word >> np.uint64(64 - BITS + 1)).astype(np.int64) | WORD
    ideograph = (code >= 0x4E00) & (code <= 0x9FFF)
    place = np.where(ideograph, code - np.uint32(0x4DFF), 0).astype(np.int64)
    two = np.flatnonzero(ideograph[:-1] & ideograph[1:])
    three = two[ideograph[np.minimum(two + 2, len(code) - 1)]]
    alone = np.flatnonzero(ideograph)
    alone = alone[~ideograph[alone + 1] & ~(ideograph[alone - 1] & (alone > 0))]
    grams = place[alone], place[two] << 15 | place[two + 1], place[three] << 30 | place[three + 1] << 15 | place[three + 2]
    return np.concatenate([row[starts], row[alone], row[two], row[three]]), np.concatenate([word, *grams])


def _hashes(terms: list[str]) -> np.ndarray:
    """The hash of each term: that of the longest token in it."""
    row, value = hashed_terms(terms)
    out = np.zeros(len(terms), np.int64)
    np.maximum.at(out, row, value)
    return out


def term_index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, category, dl, terms, counts): the index of a search, one row per chunk, made once for all searches.

    terms are the distinct hashes of the chunk's terms in order, counts how often each occurs, dl the length in terms.
    Terms are told apart by their hashes alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, SORTED):
                batch = whole.slice(begin, SORTED)
                rows, values = hashed_terms(batch.column(2).to_pylist())
                keys = np.sort(rows.astype(np.uint64) << np.uint64(BITS) | values.astype(np.uint64))
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
                counts = np.diff(np.append(first, len(keys))).astype(np.int32)
                offsets = pa.array(np.searchsorted(keys[first] >> np.uint64(BITS), np.arange(batch.num_rows + 1, dtype=np.uint64)).astype(np.int32))
                terms = (keys[first] & np.uint64((1 << BITS) - 1)).astype(np.int64)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (terms, counts)]
                lengths = pa.array(np.bincount(rows, minlength=batch.num_rows).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lengths, *lists], names=["chunk_id", "category", "dl", "terms", "counts"])

    folded = chunks.select("chunk_id", "category", T.fold(index_text()).alias("text"))
    return cut(folded.mapInArrow(run, "chunk_id string, category string, dl int, terms array<bigint>, counts array<int>"))


def _postings(batch: pa.RecordBatch, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in wanted, count) of the batch's postings of wanted terms, by row."""
    lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
    values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    held = np.flatnonzero(wanted[at] == values)
    return np.repeat(np.arange(batch.num_rows), lengths)[held], at[held], batch.column(4).flatten().to_numpy(zero_copy_only=False)[held]


class _Scorer:
    """Scores of all chunks of an index for texts, each given by the hashes of its terms.

    Terms that many texts ask and many chunks hold are weighed by matrix products, the others by their postings.
    """

    def __init__(self, index: DataFrame, texts: list[np.ndarray], n: int, average: float, idf_mode: str) -> None:
        self.average, self.texts = average, len(texts)
        pairs = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate([*texts, np.zeros(0, np.int64)])
        wanted, place = np.unique(pairs[1], return_inverse=True)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(wanted), np.int64)
            for batch in batches:
                total += np.bincount(_postings(batch, wanted)[1], minlength=len(wanted))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(total)], names=["at", "n"])

        df = np.zeros(len(wanted))
        if len(wanted):
            for r in index.mapInArrow(counted, "at bigint, n bigint").filter("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row per wanted term
                df[r["at"]] = r.n
        # Terms that no chunk holds are left out from here on.
        known = df > 0
        self.wanted, df = wanted[known], df[known]
        odds = (n - df + 0.5) / (df + 0.5)
        self.weight = np.log(1 + odds) if idf_mode == "plus_one" else np.log(odds)
        text, at = pairs[0][known[place]], (np.cumsum(known) - 1)[place][known[place]]
        self.parts = []
        for begin in range(0, len(texts), TEXTS):
            mine = slice(*np.searchsorted(text, [begin, begin + TEXTS]))
            terms, where, asking = np.unique(at[mine], return_inverse=True, return_counts=True)
            # A product costs a term as much as some two postings a chunk.
            dense = asking * df[terms] > 2 * n
            marks = np.zeros((min(TEXTS, len(texts) - begin), int(dense.sum())), bool)
            often = dense[where]
            marks[text[mine][often] - begin, (np.cumsum(dense) - 1)[where[often]]] = True
            self.parts.append((begin, marks, terms[dense], (text[mine][~often] - begin).astype(np.int64), at[mine][~often]))

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first text, scores by text and row of the batch), TEXTS texts at once."""
        if not len(self.wanted) or not batch.num_rows:
            return
        rows, at, counts = _postings(batch, self.wanted)
        order = np.argsort(at, kind="stable")
        rows, at, counts = rows[order], at[order], counts[order]
        length = 1 - B + B * batch.column(2).to_numpy() / self.average
        parts = self.weight[at] * counts * (K1 + 1) / (counts + K1 * length[rows])
        edges = np.searchsorted(at, np.arange(len(self.wanted) + 1))
        width = batch.num_rows
        for begin, marks, dense, text, term in self.parts:
            n = edges[dense + 1] - edges[dense]
            from_ = np.repeat(edges[dense] - np.cumsum(n) + n, n) + np.arange(n.sum())
            held = np.zeros((len(dense), width))
            held[np.repeat(np.arange(len(dense)), n), rows[from_]] = parts[from_]
            scores = marks.astype(float) @ held
            n = edges[term + 1] - edges[term]
            from_ = np.repeat(edges[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cells = np.repeat(text * width, n) + rows[from_]
            scores += np.bincount(cells, parts[from_], scores.size).reshape(scores.shape)
            yield begin, scores


def _facts(index: DataFrame) -> tuple[int, float]:
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return facts.n or 0, max(1.0, facts.avgdl or 0.0)


def _blocks(searches: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(query ids, categories, number of the text, texts as hashes of terms) of about BLOCK searches at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.unique(_hashes(terms or [])) for terms in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.list_(pa.int64())), batch.column(3)], names=["query_id", "category", "terms", "b"])

    category = F.col("category") if "category" in searches.columns else F.lit(None).cast("string")
    kind = searches.schema["query_id"].dataType.simpleString()
    asked = cut(searches.select("query_id", category.alias("category"), query_terms("question").alias("terms"), F.xxhash64("question").alias("b")).mapInArrow(run, f"query_id {kind}, category string, terms array<bigint>, b bigint"))
    blocks = max(1, -(-asked.count() // BLOCK))
    for block in range(blocks):
        rows = asked.filter(F.pmod("b", F.lit(blocks)) == block).toArrow()  # about BLOCK rows of a question's terms
        lists = [np.array(t, np.int64) for t in rows.column(2).to_pylist()]
        # Texts of a language stand together, and so do those that begin alike.
        order = sorted({t.tobytes() for t in lists}, key=lambda t: ((a := np.frombuffer(t, np.int64)) >= WORD).mean() if t else -1.0)
        number = {t: i for i, t in enumerate(order)}
        texts = [np.frombuffer(t, np.int64) for t in order]
        yield rows.column(0).to_pylist(), np.array(rows.column(1).to_pylist(), object), np.array([number[t.tobytes()] for t in lists], np.int64), texts


def _few(index: DataFrame) -> DataFrame:
    """The index in as many tasks as run at once: each gives k rows a search, however much it reads."""
    return index.coalesce(max(1, index.sparkSession.sparkContext.defaultParallelism))


class _Best:
    """The best k rows of each search so far; rows that tie with the k-th stay, up to as many again."""

    def __init__(self, searches: int, k: int) -> None:
        self.k, self.least = k, np.zeros(searches)
        self.search, self.score, self.chunk = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, search: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> None:
        """Rows of searches that are numbered from 0."""
        search, score, chunk = np.concatenate([self.search, search]), np.concatenate([self.score, score]), np.concatenate([self.chunk, chunk])
        order = np.lexsort((-score, search))
        search, score, chunk = search[order], score[order], chunk[order]
        first = np.searchsorted(search, np.arange(len(self.least)))
        size = np.diff(np.append(first, len(search)))
        full = np.flatnonzero(size >= self.k)
        self.least[full] = score[first[full] + self.k - 1]
        keep = score >= self.least[search]
        for i in np.flatnonzero(np.bincount(search[keep], minlength=len(self.least)) > 2 * self.k):
            span = np.arange(first[i], first[i] + size[i])[keep[first[i] : first[i] + size[i]]]
            keep[sorted(span, key=lambda j: (-score[j], chunk[j]))[self.k :]] = False
        self.search, self.score, self.chunk = search[keep], score[keep], chunk[keep]


def search_index(searches: DataFrame, index: DataFrame, k: int, idf_mode: str = "plus_one") -> DataFrame:
    """(query_id, rank, chunk_id, score): the best k chunks of each of (query_id, question) or (query_id, question, category).

    Where a search names a category only its chunks compete; the statistics stay those of the whole corpus. Ties go
    to the smaller chunk_id. Searches go over the index in blocks of BLOCK; those with the same terms are scored once.
    A task keeps the best k of each search, so what is shuffled doesn't grow with the matches.
    """
    n, average = _facts(index)
    index = _few(index)
    kind = searches.schema["query_id"].dataType
    schema, arrow = f"query_id {kind.simpleString()}, chunk_id string, score double", to_arrow_type(kind)

    def one(ids: list, categories: np.ndarray, number: np.ndarray, texts: list[np.ndarray]) -> DataFrame:
        scorer = _Scorer(index, texts, n, average, idf_mode)
        # Per TEXTS texts their searches, and of these per category the places and texts.
        parts = []
        for begin in range(0, len(texts), TEXTS):
            mine = np.flatnonzero((number >= begin) & (number < begin + TEXTS))
            named = [(c, np.array([i for i, j in enumerate(mine) if categories[j] == c], np.int64)) for c in sorted(set(categories[mine]), key=str)]
            parts.append((mine, [(c, at, number[mine[at]] - begin) for c, at in named]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(len(mine), k) for mine, _ in parts]
            for whole in batches:
                for begin in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(begin, ROWS)
                    own, chunk = (np.array(batch.column(c).to_pylist(), object) for c in (1, 0))
                    columns = {c: np.flatnonzero(own == c) for c in set(own)}
                    for start, scores in scorer.scores(batch):
                        kept = best[start // TEXTS]
                        found = [(np.zeros(0, np.int64), np.zeros(0), chunk[:0])]
                        for c, at, text in parts[start // TEXTS][1]:
                            held = None if c is None else columns.get(c)
                            if c is not None and held is None:
                                continue
                            s = scores[text] if c is None else scores[np.ix_(text, held)]
                            least = kept.least[at]
                            fresh = least <= 0
                            if s.shape[1] > k and fresh.any():
                                least[fresh] = np.partition(s[fresh], -k, axis=1)[:, -k]
                            i, j = np.nonzero(s >= np.maximum(least - 1e-6, 5e-324)[:, None])
                            found.append((at[i], np.round(s[i, j], 6), chunk[j if c is None else held[j]]))
                        new = [np.concatenate(x) for x in zip(*found)]
                        new = [x[new[1] > 0] for x in new]
                        if len(new[0]):
                            kept.add(*new)
            for kept, (mine, _) in zip(best, parts):
                if len(kept.search):
                    rows = [ids[i] for i in mine[kept.search]], kept.chunk, kept.score
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (arrow, pa.string(), pa.float64()))], names=["query_id", "chunk_id", "score"])

        return cut(index.mapInArrow(search, schema))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    found = reduce(DataFrame.unionByName, [one(*block) for block in _blocks(searches)])
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def bm25_summary(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunks, best, average): of each question that any chunk meets, how many do and their scores.

    Scores are rounded to six places each and added up in tasks, as whole millionths: a task gives one row a question.
    """
    index = term_index(chunks)
    n, average = _facts(index)
    index = _few(index)
    kind = questions.schema["query_id"].dataType
    arrow = to_arrow_type(kind)

    def one(ids: list, categories: np.ndarray, number: np.ndarray, texts: list[np.ndarray]) -> DataFrame:
        scorer = _Scorer(index, texts, n, average, "plus_one")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met, most, total = np.zeros((3, len(texts)), np.int64)
            for whole in batches:
                for begin in range(0, whole.num_rows, ROWS):
                    for start, scores in scorer.scores(whole.slice(begin, ROWS)):
                        mine = slice(start, start + TEXTS)
                        met[mine] += np.count_nonzero(scores, axis=1)
                        np.rint(np.multiply(scores, 1e6, out=scores), out=scores)
                        most[mine] = np.maximum(most[mine], scores.max(axis=1).astype(np.int64))
                        total[mine] += scores.sum(axis=1).astype(np.int64)
            at = np.flatnonzero(met[number])
            rows = [ids[i] for i in at], met[number[at]], most[number[at]], total[number[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (arrow, pa.int64(), pa.int64(), pa.int64()))], names=["query_id", "met", "most", "total"])

        return index.mapInArrow(add, f"query_id {kind.simpleString()}, met bigint, most bigint, total bigint")

    found = reduce(DataFrame.unionByName, [one(*block) for block in _blocks(questions)])
    summed = found.groupBy("query_id").agg(F.sum("met").alias("chunks"), F.max("most").alias("most"), F.sum("total").alias("total"))
    return summed.select("query_id", "chunks", F.round(F.col("most") / 1e6, 4).alias("best"), F.round(F.col("total") / 1e6 / F.col("chunks"), 4).alias("average"))


def bm25_search(questions: DataFrame, chunks: DataFrame, k: int = 10, category: str | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score): the best k chunks per question; ties go to the smaller chunk_id.

    A category filters after scoring, so the statistics stay those of the whole corpus.
    """
    searches = questions.select("query_id", "question")
    return search_index(searches if category is None else searches.withColumn("category", F.lit(category)), term_index(chunks), k)


def as_candidates(hits: DataFrame) -> DataFrame:
    """Adds what fusion needs: distance 1/(1+score) and the channel."""
    return hits.withColumn("distance", 1 / (1 + F.col("score"))).withColumn("channel", F.lit("bm25"))
