"""Text search and text functions: tokens, BM25, reranking, chunks, exact duplicates."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import stems
from spindrift.runtime import beside


K1, B = 1.5, 0.75
#: Words that are not indexed.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had what when where who which why how".split()


def words(text: Column, stop: Sequence[str] = STOP_WORDS, stem: bool = True) -> Column:
    """Lower-case runs of letters and digits of more than one byte, without stop words, each as its stem (see :mod:`spindrift.functions.stems`). A
    null text has none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))
    kept = F.coalesce(F.filter(found, lambda t: (F.octet_length(t) > 1) & ~t.isin(list(stop))), F.array().cast("array<string>"))
    return stems.stemmed(kept) if stem else kept


def terms(text: str, stop: Sequence[str] = STOP_WORDS) -> list[str]:
    """The words of a query, as :func:`words` gives them."""
    import regex

    return [t for t in regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower()) if len(t.encode()) > 1 and t not in stop]


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def bm25(documents: DataFrame, query: Sequence[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score (> 0) of the documents that hold a query word: sum of ln((N - df + .5)/(df + .5) + 1) and the saturated frequency.

    The words of the query are a literal, so that only their counts leave the scan, and they are cut to their stems like those of the texts;
    document frequencies, N and the mean length come from one aggregation over it. A repeated query word counts as often. Over many queries,
    :func:`bm25_index` reads the texts once."""
    query = [stems.stem(t) for t in query]
    terms = sorted(set(query))
    counted = documents.select(F.col(id), words(F.col(text)).alias("w")).select(id, F.size("w").alias("length"), *[_times(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("N"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    rows = beside(counted, stats)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log((F.col("N") - df + 0.5) / (df + 0.5) + 1)
        score = score + query.count(t) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.select(id, score.alias("score")).where("score > 0")


def term_overlap(documents: DataFrame, query: Sequence[str], id: str = "doc_id", text: str = "text", stem: bool = True) -> DataFrame:
    """id, score: idf of the matched distinct words over (root of the distinct words times the query's words)."""
    terms = sorted({stems.stem(t) if stem else t for t in query})
    sets = documents.select(F.col(id), F.array_distinct(words(F.col(text), stem=stem)).alias("w"))
    sets = sets.select(id, F.size("w").alias("u"), *[F.array_contains("w", t).alias(f"h{i}") for i, t in enumerate(terms)])
    stats = sets.agg(F.count("*").alias("N"), *[F.sum(F.col(f"h{i}").cast("int")).alias(f"df{i}") for i in range(len(terms))])
    rows = beside(sets, stats)
    gain = F.lit(0.0)
    for i in range(len(terms)):
        gain = gain + F.when(F.col(f"h{i}"), F.log((F.col("N") + 1) / (F.col(f"df{i}") + 1)) + 1).otherwise(0.0)
    return rows.where("u > 0").select(id, (gain / (F.sqrt(F.col("u").cast("double")) * len(terms))).alias("score")).where("score > 0")


#: Words that make a query sound like a sentence, and words that begin a question.
COMMON_WORDS = frozenset("a an the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once and but or nor so yet both either neither not only own same than too very".split())
QUESTION_WORDS = frozenset("who what where when why how which whom whose whether can could would should is are do does did will".split())
#: Weights of vectors and text by kind of query.
KIND_WEIGHTS = {"keyword": (0.3, 0.7), "semantic": (0.7, 0.3), "mixed": (0.5, 0.5)}


def query_kind(text: str) -> tuple[str, float, float]:
    """(kind, weight of vectors, weight of text) of a query, by points for and against: questions, common words and length speak for
    ``semantic``; quotes, signs, names, few and long words for ``keyword``; near ties are ``mixed``."""
    w = text.split()
    share = sum(x.lower() in COMMON_WORDS for x in w) / len(w) if w else 0.0
    plain = sum(len(x) for x in w) / len(w) if w else 0.0
    semantic = 2.0 * bool(w and w[0].lower() in QUESTION_WORDS or text.strip().endswith("?")) + (len(w) >= 5) + (share > 0.4)
    keyword = 2.0 * bool({'"', "'"} & set(text)) + 1.5 * any(not c.isalnum() and not c.isspace() and c not in "'\"?" for c in text)
    keyword += (len(w) <= 2) + (share < 0.2) + (sum(x[:1].isupper() and len(x.encode()) > 1 for x in w) >= 2) + 0.5 * (plain > 7)
    kind = "mixed" if abs(keyword - semantic) < 1 else "keyword" if keyword > semantic else "semantic"
    return (kind, *KIND_WEIGHTS[kind])


def learned_weights(feedback: DataFrame, least: int = 10) -> DataFrame:
    """kind, samples, vector_weight, text_weight of feedback (query, relevant, vector_weight, text_weight).

    The mean weights of relevant hits, from ``least`` of a kind of query on, are blended with the kind's own by samples / (samples + least), at
    most 0.8, and made to sum to 1. Kinds without feedback keep their own."""
    kind = F.udf(lambda t: query_kind(t or "")[0], "string")
    seen = feedback.where("relevant").groupBy("query").agg(F.count("*").alias("n"), F.sum("vector_weight").alias("v"), F.sum("text_weight").alias("t"))
    sums = seen.select(kind("query").alias("kind"), "n", "v", "t").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("t").alias("t"))
    own = feedback.sparkSession.createDataFrame([(k, *w) for k, w in KIND_WEIGHTS.items()], "kind string, bv double, bt double")
    blend = F.when(F.col("n") >= least, F.least(F.col("n") / (F.col("n") + least), F.lit(0.8))).otherwise(0.0)
    rows = own.join(sums, "kind", "left").withColumn("b", F.coalesce(blend, F.lit(0.0)))
    mixed = [(F.col(base) * (1 - F.col("b")) + F.coalesce(F.col(s) / F.col("n"), F.lit(0.0)) * F.col("b")).alias(name) for base, s, name in (("bv", "v", "vector_weight"), ("bt", "t", "text_weight"))]
    rows = rows.select("kind", F.coalesce("n", F.lit(0)).alias("samples"), *mixed).withColumn("total", F.col("vector_weight") + F.col("text_weight"))
    return rows.select("kind", "samples", (F.col("vector_weight") / F.col("total")).alias("vector_weight"), (F.col("text_weight") / F.col("total")).alias("text_weight"))


# ---- an index of texts -----------------------------------------------------------------------------------------------


def bm25_index(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text", append: bool = False) -> None:
    """Writes the postings (term, id, tf, length) of ``documents`` under ``path``, partitioned by a hash of the term, so that a query reads the
    partitions of its terms only. ``append`` adds documents; a document that was indexed before counts as changed, and its last state holds."""
    at = F.lit(time.time_ns())
    each = documents.select(F.col(id).cast("string").alias("id"), words(F.col(text)).alias("w")).select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term"))
    rows = each.groupBy("id", "length", "term").agg(F.count("term").alias("tf")).withColumn("at", at).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)))
    mode = "append" if append else "overwrite"
    rows.repartition("part").sortWithinPartitions("term").write.mode(mode).partitionBy("part").parquet(f"{path}/postings")
    sizes = documents.select(F.col(id).cast("string").alias("id"), F.size(words(F.col(text))).alias("length")).withColumn("at", at).withColumn("gone", F.lit(False))
    sizes.write.mode(mode).parquet(f"{path}/documents")


#: Partitions of the postings by their terms.
TERM_PARTS = 64


def bm25_remove(spark, path: str, ids: DataFrame) -> None:
    """Takes documents (id) out of an index: tombstones beside its list of documents."""
    ids.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("length"), F.lit(time.time_ns()).alias("at"), F.lit(True).alias("gone")).write.mode("append").parquet(f"{path}/documents")


def bm25_lookup(spark, path: str, query: Sequence[str]) -> DataFrame:
    """id, score (> 0) of the documents of an index that hold a word of the query; see :func:`bm25`. Only the postings of its terms are read."""
    query = [stems.stem(t) for t in query]
    asked = sorted(set(query))
    listed = spark.read.parquet(f"{path}/documents")
    live = listed.groupBy("id").agg(F.max_by(F.struct("length", "gone"), F.struct("at", "gone")).alias("d"), F.max("at").alias("at")).where("not d.gone").select("id", "at", F.col("d.length").alias("length"))
    stats = live.agg(F.count("*").alias("N"), F.avg("length").alias("mean"))
    parts = spark.range(1).select([F.pmod(F.xxhash64(F.lit(t)), F.lit(TERM_PARTS)).alias(f"p{i}") for i, t in enumerate(asked)]).first() if asked else []
    found = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(list(parts)) & F.col("term").isin(asked)) if asked else spark.read.parquet(f"{path}/postings").limit(0)
    hits = found.join(live.select("id", "at"), ["id", "at"], "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row per term of the query
    weight = F.lit(0)
    for t in asked:
        weight = F.when(F.col("term") == t, query.count(t)).otherwise(weight)
    rows = beside(hits.join(F.broadcast(df), "term"), stats)
    idf = F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(gain).alias("score"))


def coverage(text: Column, question: str) -> Column:
    """Share of the distinct words of a question that a text has, by stems."""
    wanted = sorted({stems.stem(t) for t in terms(question)})
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(words(text), F.array(*[F.lit(t) for t in wanted]))) / F.lit(float(len(wanted)))


def fixed_chunks(documents: DataFrame, size: int, overlap: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, chunk (from 0), content: pieces of ``size`` characters every ``size - overlap``, trimmed, blank ones left out."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    pieces = documents.where(F.length(text) > 0).select(id, text, F.posexplode(starts).alias("chunk", "start"))
    return pieces.select(id, "chunk", F.trim(F.substring(F.col(text), F.col("start") + 1, F.lit(size))).alias("content")).where(F.length("content") > 0)


def split_recursively(text: str, size: int, overlap: int = 0, separators: Sequence[str] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters: the first separator that splits the text is used, what is too long is split by the next, and
    neighbours are packed together, each chunk beginning with the last ``overlap`` characters of the one before."""
    def cut(part: str, level: int) -> list[str]:
        if len(part) <= size:
            return [part]
        if level == len(separators) or separators[level] == "":
            return [part[i : i + size] for i in range(0, len(part), size)]
        bits = part.split(separators[level])
        kept = [b + (separators[level] if i < len(bits) - 1 else "") for i, b in enumerate(bits)]
        return [x for b in kept if b for x in cut(b, level + 1)]

    out: list[str] = []
    held = ""
    for piece in cut(text, 0):
        if held and len(held) + len(piece) > size:
            out.append(held)
            held = held[-overlap:] if overlap and overlap + len(piece) <= size else ""
        held += piece
    return [c.strip() for c in [*out, held] if c.strip()]


def split_sentences(text: str, size: int, overlap: int = 0) -> list[str]:
    """Whole sentences (ended by . ! ?) packed to ``size`` characters; a longer sentence is a chunk by itself."""
    import regex

    out: list[str] = []
    held: list[str] = []
    for s in (m.group().strip() for m in regex.finditer(r"[^.!?]*[.!?]+|[^.!?]+\Z", text)):
        if not s:
            continue
        if held and sum(map(len, held)) + len(held) + len(s) > size:
            out.append(" ".join(held))
            kept: list[str] = []
            while held and sum(map(len, kept)) + len(kept) + len(held[-1]) <= overlap:
                kept.insert(0, held.pop())
            held = kept
        held.append(s)
    return [*out, " ".join(held)] if held else out


def split_paragraphs(text: str, size: int, overlap: int = 0) -> list[str]:
    """Paragraphs packed to ``size`` characters; longer ones are split recursively."""
    out: list[str] = []
    held = ""
    for p in (x.strip() for x in text.split("\n\n")):
        if held and len(held) + 2 + len(p) > size:
            out.append(held)
            held = ""
        if len(p) > size:
            out += split_recursively(p, size, overlap)
        elif p:
            held = held + "\n\n" + p if held else p
    return [*out, held] if held else out


def split_windows(text: str, size: int, overlap: int = 0) -> list[str]:
    """Windows of ``size`` words that move on by ``size - overlap`` words."""
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, max(1, len(w) - overlap), size - overlap)] if w else []


CHUNKERS = {"recursive": split_recursively, "sentence": split_sentences, "paragraph": split_paragraphs, "window": split_windows}
#: Strategy, size, overlap and separators by purpose.
PRESETS = {
    "rag-default": ("recursive", 512, 50, ("\n\n", "\n", ". ", " ")),
    "semantic-search": ("sentence", 1024, 100, (". ", "! ", "? ")),
    "recommendation": ("recursive", 256, 25, ("\n", ". ")),
}


def preset_chunks(documents: DataFrame, preset: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`chunks` with the values of a preset."""
    strategy, size, overlap, separators = PRESETS[preset]
    if strategy == "recursive":
        return chunks(documents, strategy, size, overlap, id, text, split=lambda t, n, o: split_recursively(t, n, o, separators))
    return chunks(documents, strategy, size, overlap, id, text)


def split_hierarchically(text: str, size: int, overlap: int = 0) -> list[str]:
    """Sections of up to four times ``size`` characters, each followed by its parts of ``size``."""
    out: list[str] = []
    for section in split_paragraphs(text, 4 * size):
        parts = split_recursively(section, size, overlap)
        out += [section, *parts] if len(parts) > 1 else [section]
    return out


def split_semantically(text: str, size: int, overlap: int = 0, least: float = 0.1) -> list[str]:
    """Sentences packed to ``size`` characters; a new chunk also begins where a sentence shares less than ``least`` of its words (Jaccard) with the chunk."""
    import regex

    out: list[str] = []
    held: list[str] = []
    seen: set[str] = set()
    for s in (m.group().strip() for m in regex.finditer(r"[^.!?]*[.!?]+|[^.!?]+\Z", text)):
        if not s:
            continue
        own = set(terms(s))
        apart = len(own & seen) < least * len(own | seen) if own and seen else False
        if held and (apart or sum(map(len, held)) + len(held) + len(s) > size):
            out.append(" ".join(held))
            held, seen = [], set()
        held.append(s)
        seen |= own
    return [*out, " ".join(held)] if held else out


CHUNKERS |= {"hierarchical": split_hierarchically, "semantic": split_semantically}


def chunks(documents: DataFrame, strategy: str, size: int, overlap: int = 0, id: str = "doc_id", text: str = "text", split=None) -> DataFrame:
    """id, chunk (from 0), content by a strategy of :data:`CHUNKERS`, or by a function of its own; null and blank texts have no chunks."""
    split = split or CHUNKERS[strategy]
    kind = dict(documents.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split(t, size, overlap) if t else [] for t in batch.column(text).to_pylist()]
            place = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id).take(place), pa.array([j for f in found for j in range(len(f))], pa.int32()), pa.array([x for f in found for x in f], pa.string())], [id, "chunk", "content"])

    return documents.select(id, text).mapInArrow(run, f"`{id}` {kind}, chunk int, content string")


def exact_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, canonical, n_copies of every row: the smallest id with the same text. Null texts are no copies of each other.

    Texts are compared by their SHA-256; only ids and digests are shuffled, and each digest's copies are combined on the map side."""
    rows = documents.select(id, F.when(F.col(text).isNotNull(), F.sha2(text, 256)).otherwise(F.concat(F.lit("null "), F.col(id).cast("string"))).alias("digest"))
    groups = rows.groupBy("digest").agg(F.min(id).alias("canonical"), F.count("*").alias("n_copies"))
    return rows.join(groups, "digest").select(id, "canonical", "n_copies")


def resolved(documents: DataFrame, key: str, how: str = "first", id: str = "doc_id", richness: Column | None = None, at: str | None = None) -> DataFrame:
    """One row per ``key``: the ``first`` id, the ``latest`` by ``at`` or the ``richest``; ties by id."""
    order = {"first": [F.col(id)], "latest": [F.desc_nulls_last(at) if at else F.col(id), F.col(id)], "richest": [F.desc_nulls_last(richness) if richness is not None else F.col(id), F.col(id)]}[how]
    return documents.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def with_context(hits: DataFrame, budget: int, id: str = "id", text: str = "text", score: str = "score") -> DataFrame:
    """The best hits whose texts fit a budget of characters together, in order: id, position, used (running total)."""
    order = W.orderBy(F.desc(score), id)  # the hits of one query
    rows = hits.withColumn("position", F.row_number().over(order)).withColumn("used", F.sum(F.length(text)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where(F.col("used") <= budget)


def inverted(documents: DataFrame, id: str = "doc_id", text: str = "text", stem: bool = True) -> DataFrame:
    """Postings: term, id, tf."""
    return documents.select(id, F.explode(words(F.col(text), stem=stem)).alias("term")).groupBy("term", id).agg(F.count("*").alias("tf"))


def entities(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, entity, n: capitalised words of three letters and more that don't begin a sentence."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<=[a-z0-9,;] )([A-Z][a-z]{2,})"), F.lit(1))
    return documents.where(F.col(text).isNotNull()).select(id, F.explode(found).alias("entity")).groupBy(id, "entity").agg(F.count("*").alias("n"))
