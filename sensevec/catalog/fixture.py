"""Shared inputs of the catalogue queries: vocabulary, tokens and a repeatable model of the given documents."""

from __future__ import annotations

from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mixer import uniform
from ..functions.text import simple_words
from ..operators import context as C
from ..operators import model as M
from ..operators import vocab as V
from ..operators.huffman import huffman_tree
from ..operators.score import broadcast_decoder, side_fits
from ..session import materialize, scratch_path
from ..sources.corpus import read_documents, scan_simple_tokens, scan_words, spread
from ..sources.nested import write_nested

MIN_FREQ = 20
WINDOW = 4
DIM = 8
SENSES = 3
ALPHA = 0.1
DISCOUNT = 0.05
SCALE = 2.0
IN_SEED, OUT_SEED, COUNT_SEED = 11, 12, 13
COUNT_SHARE = (1.0, 0.5, 0.25)

_fixtures: dict[tuple[str, str], Fixture] = {}


class Fixture:
    """Inputs derived from one data folder; model tables are written once and read by every query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @staticmethod
    def of(spark: SparkSession, folder: str) -> Fixture:
        key = (spark.sparkContext.applicationId, folder)
        if key not in _fixtures:
            _fixtures[key] = Fixture(spark, folder)
        return _fixtures[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        return read_documents(self.spark, f"{self.folder}/documents.parquet", "doc_id", "text")

    def words(self) -> DataFrame:
        return scan_simple_tokens(self.documents())

    def raw_words(self) -> DataFrame:
        return scan_words(self.documents())

    def counts(self) -> DataFrame:
        return V.word_count(self.words())

    def conversation_words(self) -> DataFrame:
        turns = self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
        return scan_simple_tokens(turns)

    def stop_words(self) -> DataFrame:
        """Words seen ten times or more in the benchmark texts."""
        words = scan_simple_tokens(self.table("benchmark"), "item_id")
        return V.word_count(words, 10).select("word")

    @cached_property
    def vocab(self) -> DataFrame:
        return materialize(V.build_vocab(self.counts(), MIN_FREQ, 0), "vocab")

    def known_words(self) -> DataFrame:
        """``(doc_id, pos, word_id)`` with original positions."""
        return V.lookup_words(self.words(), self.vocab).select("doc_id", "pos", "word_id")

    def kept(self) -> DataFrame:
        """``(doc_id, chunk_id, pos, word_id)`` with original positions."""
        return C.dealt(C.chunked(self.known_words()), self.vocab)

    def tokens(self) -> DataFrame:
        return C.encode(self.words(), self.vocab)

    def ordered_tokens(self) -> DataFrame:
        """``(doc_id, chunk_id, pos, word_id)`` of every token; each task has a stretch of the corpus."""
        return C.encode(self.words(), self.vocab, in_order=True, freq=False)

    def pairs(self, window: int = WINDOW, batch: int = C.BATCH) -> DataFrame:
        """Pairs of all windows, in tasks that can count them by chunk."""
        return C.context_pairs(C.dealt_for_pairs(C.chunked(self.known_words(), batch), self.vocab), window)

    def pair_counts(self) -> DataFrame:
        return C.both_ways(C.pair_counts(C.later_pairs(self.kept(), WINDOW)))

    def occurrences(self) -> DataFrame:
        """``(occ_id, x, ctx)`` of every token, and ``freq`` where rows are grouped by word to be scored."""
        grouped = not side_fits(self.model)
        around = C.contexts(C.encode(self.words(), self.vocab, freq=grouped), WINDOW)
        return around.select(
            F.struct("doc_id", "chunk_id", "pos").alias("occ_id"), F.col("word_id").alias("x"), "ctx", *(["freq"] if grouped else [])
        )

    @cached_property
    def model(self) -> M.SenseModel:
        """Huffman tree of the vocabulary, vectors and counts from the integer mixer."""
        vocab = self.vocab
        share = [F.col("freq") * uniform(F.col("word_id"), k + 1, 0, COUNT_SEED) * F.lit(s) for k, s in enumerate(COUNT_SHARE)]
        share[2] = F.when(F.col("word_id") % 3 == 0, F.lit(0.0)).otherwise(share[2])
        return M.SenseModel(
            vocab=vocab,
            tree=materialize(huffman_tree(vocab), "tree"),
            in_vec=materialize(M.init_in(vocab, DIM, SENSES, IN_SEED, SCALE), "in-vec"),
            out_vec=materialize(M.init_out(vocab, DIM, OUT_SEED, SCALE), "out-vec"),
            sense_counts=materialize(vocab.select("word_id", F.array(*share).alias("counts")), "counts"),
            alpha=ALPHA,
            d=DISCOUNT,
            dim=DIM,
            senses=SENSES,
        )

    @cached_property
    def decoder(self) -> Broadcast | None:
        return broadcast_decoder(self.model)

    @cached_property
    def _instances(self) -> DataFrame:
        docs = self.documents().select("doc_id", simple_words(F.col("text")).alias("ws")).filter(F.col("ws")[0] != "")
        docs = docs.withColumn("m", ((F.size("ws") + 1) / 2).cast("int"))
        return docs.select(
            "doc_id",
            F.concat(F.element_at("ws", F.col("m")), F.lit(".n")).alias("key"),
            F.col("doc_id").cast("int").alias("instance"),
            F.array_join(F.slice("ws", F.lit(1), F.col("m") - 1), " ").alias("left"),
            F.array_join(F.slice("ws", F.col("m") + 1, F.size("ws")), " ").alias("right"),
            (F.col("m") - 1).alias("position"),
            "ws",
        )

    @cached_property
    def instance_table(self) -> DataFrame:
        return materialize(self._instances, "instances")

    def instances(self) -> DataFrame:
        """The middle word of every document as a target between its left and right text."""
        return spread(self.instance_table)

    def nested(self) -> DataFrame:
        """Word, senses, contexts as nested records; the language of the document is the true sense."""
        lang = self.table("documents").select("doc_id", "lang")
        rows = self.instances().join(lang, "doc_id")
        word = F.substring_index("key", ".", 1)
        context = F.struct("position", F.col("ws").alias("words"))
        sense = F.struct(F.col("lang").alias("sense"), F.lit(1).alias("weight"), F.array(context).alias("contexts"))
        weighted = rows.withColumn("word", word).join(self.vocab.select("word", "freq"), "word")
        return weighted.select(
            "doc_id",
            F.col("word").alias("plain_word"),
            "word",
            F.col("freq").cast("int").alias("weight"),
            F.array(sense).alias("senses"),
        )

    def nested_records(self) -> DataFrame:
        """Records with several senses and contexts: two records of a word, two senses whose labels differ by a letter that is stripped."""
        lang = self.table("documents").select("doc_id", "lang")
        rows = self.instances().join(lang, "doc_id").withColumn("word", F.substring_index("key", ".", 1))
        rows = rows.join(self.vocab.select("word", "freq"), "word")
        record, accent = F.col("doc_id") % 2, F.floor(F.col("doc_id") / 2) % 2
        rows = rows.withColumn("record", record).withColumn("accent", accent)
        context = F.struct("doc_id", F.struct("position", F.col("ws").alias("words")).alias("c"))
        senses = rows.groupBy("word", "freq", "record", "lang", "accent").agg(F.sort_array(F.collect_list(context)).alias("contexts"))
        label = F.concat("lang", F.when(F.col("accent") == 1, F.lit("\u00e9")).otherwise(F.lit(""))).alias("sense")
        sense = F.struct(label, F.lit(1).alias("weight"), F.col("contexts.c").alias("contexts"))
        one = F.struct("lang", "accent", sense.alias("s"))
        words = senses.groupBy("word", "freq", "record").agg(F.sort_array(F.collect_list(one)).alias("all"))
        return words.select(
            F.col("word").alias("plain_word"), "word", F.col("freq").cast("int").alias("weight"), F.col("all.s").alias("senses")
        )

    @cached_property
    def nested_file(self) -> str:
        """These records as files in the nested line format."""
        path = scratch_path(self.spark, "nested")
        write_nested(self.nested_records(), path)
        return path

    def labels(self) -> DataFrame:
        """Line items as instances: the line number is the key, two flags are the labellings."""
        return self.table("lineitem").select(
            F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key"),
            F.col("l_orderkey").cast("int").alias("instance"),
            F.col("l_returnflag").alias("truth"),
            F.col("l_linestatus").alias("pred"),
            F.year("l_shipdate").alias("dataset"),
        )

    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("word_id"), F.lit(1).alias("sense"), F.col("embedding").alias("vec")
        )


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)
