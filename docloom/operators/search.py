"""Retrieval for batches of queries: understanding, lexical and BM25 scores over postings, vectors, fusion, anchors and the final choice.

A batch of queries (query_id, text) is searched against all sections of an index (see ``index``) at once.  Scores come from an equi-join of terms, so
no query meets a section it shares nothing with; what scores without a shared term depends on a few flags of the section alone and
enters as the best sections for each combination of intents.  Names are looked for in all texts by one automaton of the batch's names.  Ties
go to the smaller section_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.arrowmap import map_batches
from docloom.functions.text import contains_any, normalized, terms
from docloom.operators.index import FLAGS, Index, path_text
from docloom.operators.tree import structural_neighbours
from docloom.session import kept

#: Phrases that tell what a query wants, and that a section verifies something.
WANTS = {
    "commands": ["command", "commands", "run", "install", "deploy", "setup", "how to install", "what commands"],
    "yaml": ["yaml", ".yaml", ".yml", "values file", "manifest", "configuration file"],
    "output": ["output", "outputs", "expected output", "what should i expect", "what should i see", "verify", "validation", "check"],
    "script": ["script", ".sh", "shell script"],
    "steps": ["steps", "procedure", "process", "how do i", "how to"],
    "prereq": ["prerequisite", "prerequisites", "before installing", "requirements"],
}
INSTALLING = ["install", "installation", "setup", "set up", "create", "deploy", "configure", "bootstrap", "provision", "helm install", "helm upgrade"]
RELEASES = [r"helm\s+install\s+([a-zA-Z0-9._-]+)", r"helm\s+upgrade\s+([a-zA-Z0-9._-]+)", r"install\s+([a-zA-Z0-9._-]+)", r"deploy\s+([a-zA-Z0-9._-]+)"]
#: Weights of what is wanted, and of a subject's places.
WANT_WEIGHTS = {"commands": ("commands", 18), "yaml": ("yamls", 20), "output": ("outputs", 38), "script": ("scripts", 18), "steps": ("steps", 10)}
VERIFY_WEIGHT, PREREQ_WEIGHT, VERIFY_INSTALL_WEIGHT = 6, 18, 12
RELEASE_COMMAND_WEIGHT, RELEASE_CONTENT_WEIGHT = 15, 18
K1, B, RRF_K, TOP, LEXICAL_TOP = 1.2, 0.75, 60, 12, 20


#: Names that one automaton looks for, more being looked for in several passes; characters of queries that are sent to all tasks at a time.
NAMES_AT_ONCE, BATCH_CHARS = 200_000, 32 << 20


# --- queries ----------------------------------------------------------------------------------------------------


def intents(queries: DataFrame) -> DataFrame:
    """(query_id, wants_..., installs, release) of each query."""
    q = F.col("q")
    release = F.coalesce(*(F.nullif(F.regexp_extract(q, p, 1), F.lit("")) for p in RELEASES))
    rows = queries.select("query_id", normalized("text").alias("q"))
    wants = [contains_any(q, words).alias(f"wants_{name}") for name, words in WANTS.items()]
    return rows.select("query_id", *wants, contains_any(q, INSTALLING).alias("installs"), release.alias("release"))


def _contained(queries: DataFrame, keys: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, kind, key, shown): the keys of ``least`` characters or more that are a substring of the query.

    Each task makes an automaton of its own keys, NAMES_AT_ONCE at a time, that reads the texts of the batch; these go to all tasks, BATCH_CHARS at a time.
    """
    every = [tuple(r) for r in queries.select("query_id", normalized("text").alias("q")).where("q <> ''").collect()]
    schema = "query_id bigint, kind string, key string, shown string"
    out, start = None, 0
    while start < len(every) or out is None:
        end, held = start, 0
        while end < len(every) and (end == start or held + len(every[end][1]) <= BATCH_CHARS):
            held += len(every[end][1])
            end += 1
        block = every[start:end]

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            names: dict[str, list[tuple[str, str]]] = {}

            def found() -> pa.RecordBatch:
                automaton = ahocorasick.Automaton()
                for key in names:
                    automaton.add_word(key, key)
                automaton.make_automaton()
                rows = [(q, kind, key, shown) for q, text in block for key in {k for _, k in automaton.iter(text)} for kind, shown in names[key]]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["query_id", "kind", "key", "shown"])

            for batch in batches:
                for kind, key, shown in zip(*(c.to_pylist() for c in batch.columns)):
                    names.setdefault(key, []).append((kind, shown))
                if len(names) >= NAMES_AT_ONCE:
                    yield found()
                    names.clear()
            if names:
                yield found()

        part = keys.where((F.length("key") >= least) & (F.col("key") != "")).select("kind", "key", "shown").mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
        start = end
        if not every:
            break
    return out


def subjects(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, subject): a file name in the query, else the longest heading in it, the longest title, a release, a term that is a heading; or null."""
    best = F.max(F.struct(F.length("key").alias("n"), F.col("shown").alias("shown")))
    found = _contained(queries, index.keys).groupBy("query_id", "kind").agg(best.alias("best"))
    named = found.groupBy("query_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("best.shown"))).alias(k) for k in ("heading", "title")))
    file = F.nullif(F.regexp_extract("text", r"(?i)([a-zA-Z0-9._/-]+\.(?:yaml|yml|json|sh))", 1), F.lit(""))
    own = queries.select("query_id", file.alias("file")).join(intents(queries).select("query_id", "release"), "query_id").join(named, "query_id", "left")
    words = queries.select("query_id", F.posexplode(terms("text")).alias("at", "key")).join(index.keys.where("kind = 'heading'"), "key")
    word = words.groupBy("query_id").agg(F.max_by("shown", F.struct(F.length("key"), -F.col("at"))).alias("word"))
    return own.join(word, "query_id", "left").select("query_id", F.coalesce("file", "heading", "title", "release", "word").alias("subject"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term"))


@dataclass
class Batch:
    """A batch of queries with what is known of it, written once: ``wanted`` (query_id, text, wants_..., installs, release, subject), ``terms`` (query_id, term)."""

    index: Index
    wanted: DataFrame
    terms: DataFrame

    @property
    def expecting(self) -> DataFrame:
        """The queries that want the output of installing."""
        return self.wanted.where("wants_output and installs")

    @cached_property
    def expects(self) -> bool:
        return not self.expecting.isEmpty()

    @cached_property
    def points(self) -> DataFrame:
        """``subject_points`` and ``release_points`` of the batch, written once: (query_id, section_id, points, named)."""
        points = subject_points(self).withColumn("named", F.lit(False))
        released = release_points(self) if self.expects else None
        return kept(points if released is None else points.unionByName(released.withColumn("named", F.lit(True))))

    @cached_property
    def lexical(self) -> DataFrame:
        """The first of the lexical ranking, written once, as many as any use asks for."""
        return kept(ranked(node_scores(self, LEXICAL_TOP), LEXICAL_TOP))

    @cached_property
    def bridge(self) -> DataFrame | None:
        """The output bridge, written once, of the queries that want one; None without such queries."""
        return kept(output_bridge(self)) if self.expects else None


def understood(queries: DataFrame, index: Index) -> Batch:
    wanted = queries.select("query_id", "text").join(intents(queries), "query_id").join(subjects(queries, index), "query_id")
    return Batch(index, kept(wanted), kept(query_terms(queries)))


# --- names in texts ---------------------------------------------------------------------------------------------


def containing(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(section_id, field, word): the sections with a text (section_id, field, text) that contains a word (word), inside words too.

    Words are those of a batch, their number is that of its queries; one automaton of at most NAMES_AT_ONCE of them reads all texts once.
    """
    every = sorted(r[0] for r in words.where("word <> ''").select("word").distinct().collect())
    kind = texts.schema["section_id"].dataType.simpleString()
    out = None
    for start in range(0, max(1, len(every)), NAMES_AT_ONCE):
        block = every[start : start + NAMES_AT_ONCE]

        def make(block=block):
            automaton = ahocorasick.Automaton()
            for word in block:
                automaton.add_word(word, word)
            automaton.make_automaton()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                keys, fields, found = [], [], []
                for key, field, text in zip(*(c.to_pylist() for c in batch.columns)):
                    own = {word for _, word in automaton.iter(text)} if text and block else ()
                    keys += [key] * len(own)
                    fields += [field] * len(own)
                    found += own
                columns = [pa.array(keys, batch.schema.field(0).type), pa.array(fields, pa.string()), pa.array(found, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=["section_id", "field", "word"])

            return step

        part = map_batches(texts.select("section_id", "field", "text"), make, f"section_id {kind}, field string, word string")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def command_texts(index: Index) -> DataFrame:
    """(section_id, field, text): commands, normalised."""
    return index.rows.select("section_id", F.lit("command").alias("field"), F.explode("commands").alias("text")).withColumn("text", normalized("text"))


def subject_points(batch: Batch) -> DataFrame:
    """(query_id, section_id, points > 0): for each query with a subject the sections where it is found: heading equal 100 or holding it 70, path 60, content 45, title 20, a YAML file in content 30."""
    named = batch.wanted.where("subject is not null").select("query_id", "subject", normalized("subject").alias("word")).where("word <> ''")
    parts = {"heading": F.col("heading"), "path": path_text(), "content": F.col("raw_content"), "title": F.col("doc_title")}
    fields = F.array(*(F.struct(F.lit(name).alias("field"), normalized(x).alias("text")) for name, x in parts.items()))
    texts = batch.index.rows.select("section_id", F.explode(fields).alias("f")).select("section_id", "f.field", "f.text")
    found = containing(texts, named.select("word"))
    has = {name: F.max(F.col("field") == name).alias(name) for name in parts}
    met = found.groupBy("section_id", "word").agg(*has.values()).join(named, "word")
    met = met.join(batch.index.rows.select("section_id", normalized("heading").alias("own")), "section_id")
    points = F.when(F.col("own") == F.col("word"), 100).when(F.col("heading"), 70).otherwise(0)
    for name, weight in (("path", 60), ("content", 45), ("title", 20)):
        points = points + F.when(F.col(name), weight).otherwise(0)
    points = points + F.when(F.col("content") & (F.col("subject").endswith(".yaml") | F.col("subject").endswith(".yml")), 30).otherwise(0)
    return met.select("query_id", "section_id", points.cast("double").alias("points"))


def release_points(batch: Batch) -> DataFrame | None:
    """(query_id, section_id, points) for queries that want the output of installing a release: its name in a command, and in the content of a section with outputs; None without such queries."""
    release = batch.expecting.where("release is not null").select("query_id", F.col("release").alias("word"))
    if release.isEmpty():
        return None
    contents = batch.index.rows.where("has_outputs").select("section_id", F.lit("content").alias("field"), normalized("raw_content").alias("text"))
    found = containing(command_texts(batch.index).unionByName(contents), release.select("word"))
    weight = F.when(F.col("field") == "command", float(RELEASE_COMMAND_WEIGHT)).otherwise(float(RELEASE_CONTENT_WEIGHT))
    return found.groupBy("section_id", "word").agg(F.sum(weight).alias("points")).join(release, "word").select("query_id", "section_id", "points")


# --- lexical and BM25 scores --------------------------------------------------------------------------------------


def shared_weights(batch: Batch) -> DataFrame:
    """(query_id, section_id, score): the weight of each shared term."""
    return batch.index.postings.where("weight > 0").join(batch.terms, "term").select("query_id", "section_id", F.col("weight").cast("double").alias("score"))


def overlap_scores(batch: Batch) -> DataFrame:
    """(query_id, section_id, score): weighted numbers of shared terms."""
    return shared_weights(batch).groupBy("query_id", "section_id").agg(F.sum("score").cast("double").alias("score"))


def flag_score() -> Column:
    """What flags of a section add to its score for a query's intents."""
    total = F.when(F.col("verifies"), VERIFY_WEIGHT).otherwise(0)
    for want, (artefact, weight) in WANT_WEIGHTS.items():
        total = total + F.when(F.col(f"wants_{want}") & F.col(f"has_{artefact}"), weight).otherwise(0)
    total = total + F.when(F.col("wants_prereq") & F.col("prepares"), PREREQ_WEIGHT).otherwise(0)
    return (total + F.when(F.col("wants_output") & F.col("installs") & F.col("verifies_install"), VERIFY_INSTALL_WEIGHT).otherwise(0)).cast("double")


ASKS = [*(f"wants_{w}" for w in WANTS), "installs"]


def prior(batch: Batch, top: int) -> DataFrame:
    """(query_id, section_id): for each query the ``top`` sections of best flags for its intents.

    A section's flags and a query's intents are a few booleans each.  The first ``top`` sections of each combination of flags are all that
    can come first by flags; they are scored once for each combination of intents there is, and queries meet them by that combination.
    """
    held = batch.index.rows.where(" or ".join(FLAGS)).select("section_id", *FLAGS)
    firsts = held.withColumn("n", F.row_number().over(Window.partitionBy(*FLAGS).orderBy("section_id"))).where(F.col("n") <= top).drop("n")
    asks = F.concat_ws("", *(F.col(a).cast("int").cast("string") for a in ASKS))
    combos = [(r["asks"], [r[a] for a in ASKS]) for r in batch.wanted.select(asks.alias("asks"), *ASKS).distinct().collect()]  # at most 2 ** 7
    every = F.array(*(F.struct(F.lit(key).alias("asks"), *(F.lit(v).alias(a) for a, v in zip(ASKS, values))) for key, values in combos)) if combos else None
    if every is None:
        return batch.wanted.select("query_id", F.lit(None).cast("bigint").alias("section_id")).limit(0)
    scored = firsts.select("section_id", *FLAGS, F.explode(every).alias("a")).select("section_id", *FLAGS, "a.*").withColumn("score", flag_score()).where("score > 0")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("score"), "section_id"))).where(F.col("n") <= top).select("asks", "section_id")
    return batch.wanted.select("query_id", asks.alias("asks")).join(F.broadcast(best), "asks").select("query_id", "section_id")  # at most top for each of 2 ** 7


def node_scores(batch: Batch, top: int = TOP) -> DataFrame:
    """(query_id, section_id, score > 0) of all sections that share a term with the query, hold its subject or release, or are among the ``top`` first by their flags."""
    # one sum over all there is
    parts = shared_weights(batch).unionByName(prior(batch, top).withColumn("score", F.lit(0.0)))
    parts = parts.unionByName(batch.points.select("query_id", "section_id", F.col("points").alias("score")))
    met = parts.groupBy("query_id", "section_id").agg(F.sum("score").alias("shared"))
    scored = met.join(batch.index.rows.select("section_id", *FLAGS), "section_id").join(batch.wanted.select("query_id", *ASKS), "query_id")
    return scored.select("query_id", "section_id", (F.col("shared") + flag_score()).alias("score")).where("score > 0")


def ranked(scores: DataFrame, top: int | None = None, by: str = "query_id") -> DataFrame:
    """Scores with their rank, from 1, within each query; ties by section_id."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "section_id")))
    return out if top is None else out.where(F.col("rank") <= top)


def lexical_search(batch: Batch, top: int = TOP) -> DataFrame:
    return batch.lexical.where(F.col("rank") <= top) if top <= LEXICAL_TOP else ranked(node_scores(batch, top), top)


def bm25_search(batch: Batch, top: int = TOP, k1: float = K1, b: float = B) -> DataFrame:
    """Okapi BM25 over the retrieval content: idf = ln(1 + (N - df + 0.5) / (df + 0.5)); scores to six digits."""
    asked = batch.terms.join(batch.index.terms, "term")
    tf = batch.index.postings.where("tf > 0").join(asked, "term")
    idf = F.log(1 + (F.lit(float(batch.index.count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(batch.index.mean or 1.0))))
    return ranked(tf.groupBy("query_id", "section_id").agg(F.round(F.sum(gain), 6).alias("score")), top)


# --- vectors ----------------------------------------------------------------------------------------------------

#: Query vectors that are searched at a time; each block passes over all rows once.
VECTOR_BLOCK = 4096


def vector_search(vectors: DataFrame, asked: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 10, same: bool = True) -> DataFrame:
    """(query_id, key, score, rank): the ``top`` rows of greatest cosine with each asked vector; where queries are rows of the ``same`` table, itself not counted.

    Exact.  Blocks of asked vectors (query_id, vector) meet all rows by matrix products in Arrow batches; a batch passes on
    its own ``top`` of each query.  Null, empty and zero vectors have no cosine.
    """
    kind = vectors.schema[key].dataType.simpleString()
    usable = asked.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select("query_id", vector)
    count = usable.count()
    blocks = max(1, -(-count // VECTOR_BLOCK))
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, vector)
    parts = None
    for block in range(blocks):
        own = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        ids = np.array([r[0] for r in own], np.int64)
        stack = np.array([r[1] for r in own], np.float64) if own else np.zeros((0, 1))

        def search(batches: Iterator[pa.RecordBatch], ids=ids, stack=stack) -> Iterator[pa.RecordBatch]:
            norms = np.linalg.norm(stack, axis=1)
            unit = stack / np.where(norms, norms, 1)[:, None]
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                lists = batch.column(1)
                width = stack.shape[1] if stack.size else 0
                right = np.array(lists.value_lengths()) == width
                if not right.any() or not len(ids):
                    continue
                held = lists.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                keys = keys[right]
                sizes = np.linalg.norm(held, axis=1)
                cosine = unit @ (held / np.where(sizes, sizes, 1)[:, None]).T
                if same:
                    cosine[ids[:, None] == keys[None, :]] = -np.inf
                cosine[:, sizes == 0] = -np.inf
                cosine[norms == 0] = -np.inf
                cosine = np.round(cosine, 6)
                many = min(top, len(keys))
                # what reaches the score of the last of the first ``many`` is passed on, ties and all: the final ranking settles those by key
                edge = -np.partition(-cosine, many - 1, axis=1)[:, many - 1 : many]
                q, at = np.nonzero((cosine >= edge) & np.isfinite(cosine))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[at], batch.schema.field(0).type), pa.array(cosine[q, at])], names=["query_id", key, "score"])

        part = rows.mapInArrow(search, f"query_id bigint, {key} {kind}, score double")
        parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# --- fusion and choice ------------------------------------------------------------------------------------------


def minmax(scores: DataFrame, by: list[str]) -> DataFrame:
    """Scores scaled to 0..1 within each group; 1 if all are equal."""
    over = Window.partitionBy(*by)
    low, high = F.min("score").over(over), F.max("score").over(over)
    return scores.withColumn("scaled", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, section_id, rrf): sums of 1 / (k + rank) over retrievers."""
    return rankings.groupBy("query_id", "section_id").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))


#: Shares of the retrievers in the combined score, and boosts; sections that stand for a ranking where nothing scores.
SHARES, RRF_WEIGHT, EXACT_BOOST, DESCENDANT_BOOST, BRIDGE_BOOST, FALLBACK = {"lexical": 0.45, "bm25": 0.30, "vector": 0.25}, 10.0, 2.0, 1.2, 2.75, 20


def combined(batch: Batch, vectors: DataFrame | None = None, top: int = TOP, bridge: DataFrame | None = None) -> DataFrame:
    """(query_id, section_id, score, rank): scaled scores of all retrievers, reciprocal ranks and boosts of an exact subject and of the output bridge, in one sum.

    ``vectors`` are rankings (query_id, section_id, score, rank) of a vector retriever; without them it adds nothing.  A query for which nothing scores
    gets the first FALLBACK sections, with a score of 0.
    """
    every = lexical_search(batch, top).withColumn("retriever", F.lit("lexical")).unionByName(bm25_search(batch, top).withColumn("retriever", F.lit("bm25")))
    if vectors is not None:
        every = every.unionByName(vectors.select("query_id", "section_id", "score", "rank").withColumn("retriever", F.lit("vector")))
    share = F.create_map(*(F.lit(x) for pair in SHARES.items() for x in pair))
    scaled = minmax(every, ["query_id", "retriever"])
    part = F.col("scaled") * share[F.col("retriever")] + F.lit(RRF_WEIGHT) / (F.lit(float(RRF_K)) + F.col("rank"))
    exact = exact_subjects(batch)
    every = scaled.select("query_id", "section_id", part.alias("part")).unionByName(exact.withColumn("part", F.lit(EXACT_BOOST)))
    below = exact.withColumnRenamed("section_id", "ancestor").join(batch.index.closure.where("useful"), "ancestor")
    every = every.unionByName(below.select("query_id", F.col("descendant").alias("section_id"), F.lit(DESCENDANT_BOOST).alias("part")))
    bridge = bridge if bridge is not None else batch.bridge
    if bridge is not None:
        every = every.unionByName(bridge.select("query_id", "section_id", F.lit(BRIDGE_BOOST).alias("part")))
    total = every.groupBy("query_id", "section_id").agg(F.round(F.sum("part"), 6).alias("score"))
    first = [r[0] for r in batch.index.rows.select("section_id").orderBy("section_id").limit(FALLBACK).collect()]
    if first:
        total = kept(total)
        bare = batch.wanted.select("query_id").join(total.select("query_id").distinct(), "query_id", "left_anti")
        total = total.unionByName(bare.select("query_id", F.explode(F.lit(first)).alias("section_id"), F.lit(0.0).alias("score")))
    return ranked(total)


def exact_subjects(batch: Batch) -> DataFrame:
    """(query_id, section_id): sections whose heading or title is the query's subject."""
    named = batch.wanted.where("subject is not null").select("query_id", normalized("subject").alias("key"))
    keys = batch.index.rows.select("section_id", F.explode(F.array_distinct(F.array(normalized("heading"), normalized("doc_title")))).alias("key")).where("key <> ''")
    return keys.join(named, "key").select("query_id", "section_id").distinct()


VERBS = ("helm install", "helm upgrade")


def command_matches(batch: Batch, of: DataFrame | None = None) -> DataFrame:
    """(query_id, section_id): sections with a command that contains the query's release, or that installs or upgrades by helm as the query says.  ``of`` are the queries asked for."""
    wanted = of if of is not None else batch.wanted
    commands = command_texts(batch.index)

    def said(text: str | Column) -> Column:
        return F.filter(F.array(*(F.when(normalized(text).contains(v), F.lit(v)) for v in VERBS)), lambda x: x.isNotNull())

    release = wanted.where("release is not null").select("query_id", F.col("release").alias("word"))
    named = containing(commands, release.select("word")).join(release, "word")
    verbs = commands.select("section_id", F.explode(said("text")).alias("verb")).distinct()
    both = verbs.join(wanted.select("query_id", F.explode(said("text")).alias("verb")), "verb")
    return named.select("query_id", "section_id").unionByName(both.select("query_id", "section_id")).distinct()


def output_bridge(batch: Batch, radius: int = 3) -> DataFrame:
    """(query_id, section_id, place): for queries that want the output of installing, the sections around matching commands that
    hold outputs or verify: first the structural neighbours of each command's section, then its file's sections with outputs."""
    matched = kept(command_matches(batch, batch.expecting))
    near = structural_neighbours(batch.index, radius, of=matched.select("section_id").distinct())
    around = matched.join(near, "section_id").select("query_id", "section_id", F.lit(0).alias("kind"), F.col("place").cast("bigint").alias("at"), "neighbour")
    files = batch.index.rows.select("section_id", "file_path", "has_outputs", "verifies")
    holding = files.where("has_outputs").select("file_path", F.col("section_id").alias("neighbour"))
    same = matched.join(files, "section_id").join(holding, "file_path").select("query_id", "section_id", F.lit(1).alias("kind"), F.col("neighbour").alias("at"), "neighbour")
    verifying = files.where("has_outputs or verifies").select(F.col("section_id").alias("neighbour"))
    first = around.unionByName(same).join(verifying, "neighbour", "left_semi").groupBy("query_id", "neighbour").agg(F.min(F.struct("section_id", "kind", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first.section_id", "first.kind", "first.at", "neighbour"))
    return first.select("query_id", F.col("neighbour").alias("section_id"), place.alias("place"))


def with_bridge(chosen: DataFrame, bridge: DataFrame, top: int = 10) -> DataFrame:
    """Chosen sections (query_id, section_id, rank) with those of an output bridge before them, where a query has one."""
    met = chosen.select("query_id", "section_id", F.lit(1).alias("kind"), F.col("rank").alias("at"))
    met = met.unionByName(bridge.select("query_id", "section_id", F.lit(0).alias("kind"), F.col("place").alias("at")))
    first = met.groupBy("query_id", "section_id").agg(F.min(F.struct("kind", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("first.kind", "first.at", "section_id"))
    return first.select("query_id", "section_id", rank.alias("rank")).where(F.col("rank") <= top)


def anchors(batch: Batch, found: DataFrame) -> DataFrame:
    """(query_id, section_id): of the first 20 of each ranking the one with the best score for itself, its useful descendants and its subject."""
    first = found.where("rank <= 20").select("query_id", "section_id", "rank")
    useful = batch.index.closure.where("useful").groupBy(F.col("ancestor").alias("section_id")).agg(F.count("*").alias("useful"))
    held = batch.index.rows.select("section_id", *FLAGS).join(first, "section_id").join(useful, "section_id", "left").join(batch.wanted.select("query_id", *ASKS), "query_id")
    own = overlap_scores(batch).join(first.select("query_id", "section_id"), ["query_id", "section_id"])
    points = batch.points.select("query_id", "section_id", (F.col("points") + F.when(F.col("named"), 0.0).otherwise(10.0)).alias("score"))
    parts = own.select("query_id", "section_id", "score").unionByName(points)
    shared = parts.groupBy("query_id", "section_id").agg(F.sum("score").alias("shared"))
    score = F.coalesce("shared", F.lit(0.0)) + flag_score() + F.least(F.coalesce("useful", F.lit(0)), F.lit(10)) * 4
    rows = held.join(shared, ["query_id", "section_id"], "left").withColumn("score", score)
    return rows.groupBy("query_id").agg(F.max_by("section_id", F.struct("score", -F.col("rank"))).alias("section_id"))


def expansion(batch: Batch, anchor: DataFrame) -> DataFrame:
    """(query_id, section_id, kind, at): anchors (query_id, section_id), their useful descendants, and the useful sections of their files, in this order."""
    own = anchor.select("query_id", "section_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"))
    below = anchor.select("query_id", F.col("section_id").alias("ancestor")).join(batch.index.closure.where("useful"), "ancestor")
    down = below.select("query_id", F.col("descendant").alias("section_id"), F.lit(1).alias("kind"), (F.col("distance") * F.lit(1 << 40) + F.col("descendant")).alias("at"))
    rows = batch.index.rows
    useful = rows.where("useful").select("file_path", F.col("section_id").alias("other"))
    same = rows.select("section_id", "file_path").join(anchor.select("query_id", "section_id"), "section_id").join(useful, "file_path").where("other <> section_id")
    return own.unionByName(down).unionByName(same.select("query_id", F.col("other").alias("section_id"), F.lit(2).alias("kind"), F.col("other").alias("at")))


def chosen_of(every: DataFrame, top: int) -> DataFrame:
    """(query_id, section_id, rank): sections (query_id, section_id, kind, at) by kind and place, each once, the first ``top``."""
    first = every.groupBy("query_id", "section_id").agg(F.min(F.struct("kind", "at")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first.kind", "first.at", "section_id")
    return first.select("query_id", "section_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)


EXPANDS = " or ".join(f"wants_{w}" for w in WANT_WEIGHTS)


def hybrid_search(batch: Batch, top: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, section_id, rank): the sections chosen for each query.

    A query that wants the output of installing gets its output bridge and then the ranking, if it has a bridge.  Another that wants commands, YAML, output,
    scripts or steps gets its anchor, the anchor's useful descendants, the useful sections of its file, and for output the first six found that hold outputs; any
    other the ranking.
    """
    bridge = batch.bridge
    found = kept(combined(batch, vectors, bridge=bridge))
    wanted = batch.wanted.select("query_id", "wants_output", F.expr(EXPANDS).alias("expands"))
    if bridge is not None:
        bridged = bridge.select("query_id").distinct().withColumn("bridged", F.lit(True))
        wanted = wanted.join(bridged, "query_id", "left").withColumn("expands", F.col("expands") & F.col("bridged").isNull()).drop("bridged")
    wanted = kept(wanted)
    anchor = kept(anchors(batch, found).join(wanted.where("expands"), "query_id", "left_semi"))
    outputs = found.join(batch.index.rows.where("has_outputs").select("section_id"), "section_id").join(wanted.where("wants_output and expands").select("query_id"), "query_id")
    outputs = outputs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("n <= 6")
    outputs = outputs.select("query_id", "section_id", F.lit(3).alias("kind"), F.col("rank").cast("bigint").alias("at"))
    plain = found.join(wanted.where("not expands").select("query_id"), "query_id").select("query_id", "section_id", F.lit(4).alias("kind"), F.col("rank").cast("bigint").alias("at"))
    every = expansion(batch, anchor).unionByName(outputs).unionByName(plain)
    if bridge is not None:
        every = every.unionByName(bridge.select("query_id", "section_id", F.lit(-1).alias("kind"), F.col("place").cast("bigint").alias("at")))
    return chosen_of(every, top)
