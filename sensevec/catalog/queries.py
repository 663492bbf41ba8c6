"""The catalogue: one query per operator, ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as X
from ..functions.priors import expected_logpi, expected_pi, sense_count
from ..operators import context as C
from ..operators import huffman as H
from ..operators import metrics as E
from ..operators import model as M
from ..operators import neighbors as N
from ..operators import reading as RO
from ..operators import score as S
from ..operators import summation as K
from ..operators import train as R
from ..operators import vocab as V
from ..operators import wsi
from ..plans.likelihood import LIKELIHOOD_BATCH
from ..plans.train import TrainParams, train
from ..session import materialize, scratch_path
from ..sources import dictionary as D
from ..sources import vectors as XS
from ..sources import nested as NS
from ..sources import wsi as WS
from ..streaming import counts as stream_counts
from ..streaming import score as stream_score
from .fixture import ALPHA, DIM, DISCOUNT, MIN_FREQ, SENSES, WINDOW, Fixture, rounded

PRIME = 2147483647
WSI_WINDOW = 5
LR = 0.025
THRESHOLD = 1e-10
CAP = 250.0
KEEP = 1e-3

Query = Callable[[Fixture], DataFrame]
_catalogue: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _catalogue[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Fixture.of(spark, folder))

    return {name: bind(fn) for name, fn in _catalogue.items()}


def _wide(df: DataFrame, array: str, prefix: str, digits: int = 6) -> list:
    return [F.round(F.col(array)[k], digits).alias(f"{prefix}{k + 1}") for k in range(SENSES)]


def _cells(df: DataFrame, *keys: str, vec: str = "vec", digits: int = 6) -> DataFrame:
    """One row per array element, counting from 0."""
    rows = df.select(*keys, F.posexplode(vec).alias("i", "value"))
    return rows.select(*keys, "i", F.round(F.col("value").cast("double"), digits).alias("value"))


# --- sources and text ---------------------------------------------------------------------------------------


@query
def scan_words(f: Fixture) -> DataFrame:
    return f.raw_words()


@query
def encode_corpus(f: Fixture) -> DataFrame:
    return f.tokens().select("doc_id", "chunk_id", "pos", "word_id")


@query
def encode_text(f: Fixture) -> DataFrame:
    return C.encode(f.conversation_words(), f.vocab).select("doc_id", "chunk_id", "pos", "word_id")


@query
def epoch_tokens(f: Fixture) -> DataFrame:
    tokens = V.repeat_epochs(f.tokens(), 2)
    check = F.sum((F.col("pos").cast("bigint") * 8191 + F.col("word_id")) % PRIME)
    return tokens.groupBy("doc_id", "epoch").agg(F.count("*").alias("n"), check.alias("checksum"))


def _dictionary_lines(f: Fixture) -> DataFrame:
    """Lines of a dictionary, with running text among them as malformed lines."""
    good = D.dictionary_lines(V.word_count(f.raw_words())).select("value")
    return good.unionByName(f.table("benchmark").select(F.col("text").alias("value")))


@query
def read_dictionary(f: Fixture) -> DataFrame:
    return D.parse_lines(_dictionary_lines(f))


@query
def write_dictionary(f: Fixture) -> DataFrame:
    path = scratch_path(f.spark, "dictionary")
    D.write_dictionary(f.counts(), path)
    return f.spark.read.text(path).select(F.col("value").alias("line"))


@query
def save_model_pruned(f: Fixture) -> DataFrame:
    return M.pruned_in(f.model, KEEP).select("word_id", "sense")


@query
def load_model(f: Fixture) -> DataFrame:
    path = scratch_path(f.spark, "model")
    M.save_model(f.model, path, KEEP)
    loaded = M.load_model(f.spark, path)
    sizes = [
        getattr(loaded, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in M.SenseModel.TABLES
    ]
    out = sizes[0]
    for df in sizes[1:]:
        out = out.unionByName(df)
    return out


@query
def export_vectors(f: Fixture) -> DataFrame:
    lines = XS.vector_lines(f.model)
    fields = F.split("value", " ")
    return lines.select("word_id", fields[0].alias("word"), F.size(fields).alias("fields"))


@query
def import_vectors(f: Fixture) -> DataFrame:
    path = scratch_path(f.spark, "vectors")
    XS.write_vectors(f.model, path)
    return _cells(XS.read_vectors(f.spark, path), "word")


def _context_lines(f: Fixture) -> DataFrame:
    """The instances as a numbered context file."""
    rows = f.instances().select("doc_id", "key", "left", "right")
    heads = rows.groupBy("key").agg(F.count("*").alias("n"))
    # one row per target word
    before = W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.withColumn("at", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    number = F.row_number().over(W.partitionBy("key").orderBy("doc_id"))
    body = rows.join(heads, "key").select(
        (F.col("at") + number).alias("line_no"), F.concat("left", F.lit("\t"), "right").alias("value")
    )
    head = heads.select(F.col("at").alias("line_no"), F.concat_ws(" ", "key", F.col("n").cast("string")).alias("value"))
    return head.unionByName(body)


@query
def wsi_instances(f: Fixture) -> DataFrame:
    return WS.parse_context_lines(_context_lines(f))


@query
def wsi_prediction_lines(f: Fixture) -> DataFrame:
    predicted = wsi.predict(f.instances(), f.model, WSI_WINDOW, f.decoder)
    return WS.prediction_lines(predicted).select(F.col("value").alias("line"))


@query
def read_answers(f: Fixture) -> DataFrame:
    answers = f.labels().select("key", "instance", F.col("truth").alias("sense"))
    return WS.parse_answer_lines(WS.answer_lines(answers))


@query
def wwsi_contexts(f: Fixture) -> DataFrame:
    flat = WS.flatten_weighted(f.nested(), "doc_id")
    return flat.select(
        "doc_id", "word", "weight", "sense", "sense_weight", "has_utf", "context_id", "position", F.size("words").alias("words")
    )


@query
def wwsi_nested_file(f: Fixture) -> DataFrame:
    """Contexts read from files in which lines are nested by counts."""
    rows = NS.read_nested(f.spark, f.nested_file)
    kept = ["word", "weight", "sense_no", "sense", "sense_weight", "has_utf", "context_id", "position"]
    return rows.select(*kept, F.array_join("words", " ").alias("text"))


@query
def stop_word_file(f: Fixture) -> DataFrame:
    path = scratch_path(f.spark, "stop-words")
    f.stop_words().select(F.col("word").alias("value")).write.text(path)
    return D.read_stop_words(f.spark, path).select("word")


@query
def model_vectors(f: Fixture) -> DataFrame:
    """Vectors of the senses that a saved model keeps, as they are read back."""
    path = scratch_path(f.spark, "model")
    M.save_model(f.model, path, KEEP)
    return _cells(M.load_model(f.spark, path).in_vec, "word_id", "sense")


@query
def tokenize_simple(f: Fixture) -> DataFrame:
    return f.table("pages").select("page_id", T.simple_tokenize(F.col("html")).alias("tokens"))


@query
def clean_tokens(f: Fixture) -> DataFrame:
    turns = f.table("conversations")
    # accented capitals fold differently from engine to engine, so the text is stripped to ASCII first
    return turns.select("conv_id", "turn", T.clean_tokens(T.strip_non_ascii(F.col("text"))).alias("tokens"))


@query
def blank_predicate(f: Fixture) -> DataFrame:
    cell = F.explode(F.split("text", "\n")).alias("line")
    lines = f.table("documents").select("doc_id", cell)
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_blank(F.col("line"))).alias("blank"))


@query
def strip_non_ascii(f: Fixture) -> DataFrame:
    text = F.col("text")
    return f.table("conversations").select(
        "conv_id", "turn", T.strip_non_ascii(text).alias("ascii"), T.has_non_ascii(text).alias("has_utf")
    )


# --- vocabulary ---------------------------------------------------------------------------------------------


@query
def word_count(f: Fixture) -> DataFrame:
    return V.word_count(f.words())


@query
def vocab_min_freq(f: Fixture) -> DataFrame:
    return V.filter_counts(f.counts(), min_freq=5)


@query
def vocab_stopwords(f: Fixture) -> DataFrame:
    return V.filter_counts(f.counts(), stop_words=f.stop_words())


@query
def vocab_regex(f: Fixture) -> DataFrame:
    return V.filter_counts(f.counts(), regex="^[a-z]+$")


@query
def vocab_ids(f: Fixture) -> DataFrame:
    return V.assign_ids(f.counts())


@query
def vocab_remove_top_k(f: Fixture) -> DataFrame:
    return V.assign_ids(f.counts(), remove_top_k=70)


@query
def build_vocab(f: Fixture) -> DataFrame:
    return V.build_vocab(f.counts(), 5, 70, f.stop_words(), "^[a-z]+$")


@query
def build_from_text(f: Fixture) -> DataFrame:
    return V.assign_ids(V.word_count(f.raw_words(), min_freq=5))


@query
def lookup_word(f: Fixture) -> DataFrame:
    words = V.word_count(f.conversation_words()).withColumnRenamed("freq", "n")
    ids = V.lookup_words(words, f.vocab, ("word_id",)).select("word_id", "n")
    return V.lookup_ids(ids, f.vocab).select("word_id", "word", "n")


@query
def vocab_total(f: Fixture) -> DataFrame:
    return V.total_frequency(f.vocab)


@query
def subsample(f: Fixture) -> DataFrame:
    total = V.total_frequency(f.vocab).first()["total"]
    kept = V.subsample(f.tokens(), total, 1e-3)
    drawn = kept.groupBy("word_id").agg(F.count("*").alias("drawn"))
    keep = V.keep_probability(F.col("freq"), F.lit(float(total)), 1e-3)
    return f.vocab.join(drawn, "word_id", "left").select(
        "word_id", "freq", F.round(keep, 6).alias("keep"), F.coalesce("drawn", F.lit(0)).alias("drawn")
    )


@query
def preprocess(f: Fixture) -> DataFrame:
    kept = V.preprocess(f.tokens(), f.vocab, min_freq=50, threshold=1e-4)
    return kept.groupBy("word_id").agg(F.count("*").alias("n"))


# --- tree and initial model ---------------------------------------------------------------------------------


@query
def huffman_total_cost(f: Fixture) -> DataFrame:
    return H.tree_summary(H.huffman_tree(f.vocab), f.vocab)


@query
def huffman_codes(f: Fixture) -> DataFrame:
    return H.huffman_tree(f.vocab)


@query
def huffman_depth(f: Fixture) -> DataFrame:
    return H.code_lengths(H.huffman_tree(f.vocab))


@query
def init_vectors(f: Fixture) -> DataFrame:
    return _cells(M.init_in(f.vocab, DIM, SENSES, seed=1), "word_id", "sense", digits=9)


@query
def zero_vectors(f: Fixture) -> DataFrame:
    zero = M.zero_model(f.vocab, DIM, SENSES)
    return zero.in_vec.select("word_id", "sense", F.size("vec").alias("width"), X.norm(F.col("vec")).alias("norm"))


@query
def init_counts(f: Fixture) -> DataFrame:
    return M.init_counts(f.vocab, SENSES).select("word_id", *_wide(f.vocab, "counts", "c"))


# --- contexts -----------------------------------------------------------------------------------------------


def _pair_checks(pairs: DataFrame) -> DataFrame:
    code = F.col("pos").cast("bigint") * 1000003 + F.col("x").cast("bigint") * 8191 + F.col("y")
    return pairs.groupBy("doc_id", "chunk_id").agg(
        F.count("*").alias("pairs"), F.sum(code % PRIME).alias("checksum")
    )


@query
def context_pairs(f: Fixture) -> DataFrame:
    return _pair_checks(C.context_pairs(f.tokens(), WINDOW))


@query
def context_cut(f: Fixture) -> DataFrame:
    return _pair_checks(C.context_pairs(f.tokens(), WINDOW, cut=True))


@query
def pair_counts(f: Fixture) -> DataFrame:
    return f.pair_counts()


@query
def wsi_context(f: Fixture) -> DataFrame:
    return wsi.context_words(f.instances(), f.vocab, WSI_WINDOW, ["key", "instance"])


def _weighted_rows(f: Fixture) -> DataFrame:
    return WS.flatten_weighted(f.nested(), "doc_id").withColumn("context_id", F.col("doc_id"))


@query
def wwsi_context(f: Fixture) -> DataFrame:
    keys = ["word", "sense", "context_id"]
    return wsi.weighted_context_words(_weighted_rows(f), f.vocab, WSI_WINDOW, keys, f.stop_words())


@query
def reading_order(f: Fixture) -> DataFrame:
    """Where the tokens of each document stand in the whole corpus."""
    placed = RO.numbered(f.tokens())
    return placed.groupBy("doc_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def _ordered(f: Fixture) -> DataFrame:
    around = C.contexts(RO.numbered(f.ordered_tokens(), in_order=True), WINDOW)
    place = ["doc_id", "chunk_id", "pos"]
    rows = around.select(*place, F.col("word_id").alias("x"), "ctx", "at")
    ranked = RO.followers(rows, ["x"], tasks=C.stretches_of(f.vocab), order=place)
    return ranked.select(F.struct(*place).alias("occ_id"), "x", "ctx", "behind")


@query
def later_occurrences(f: Fixture) -> DataFrame:
    return _ordered(f).select("occ_id.*", "behind")


# --- priors and scalar functions ----------------------------------------------------------------------------


def _senses(df: DataFrame, column, *keys: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode(column).alias("k", "p"))
    return rows.select(*keys, (F.col("k") + 1).alias("sense"), rounded("p", 8))


@query
def expected_pi_(f: Fixture) -> DataFrame:
    return _senses(f.model.sense_counts, expected_pi(F.col("counts"), ALPHA, DISCOUNT), "word_id")


@query
def expected_logpi_(f: Fixture) -> DataFrame:
    return _senses(f.model.sense_counts, expected_logpi(F.col("counts"), ALPHA, DISCOUNT), "word_id")


@query
def sense_count_(f: Fixture) -> DataFrame:
    pi = expected_pi(F.col("counts"), ALPHA, DISCOUNT)
    return f.model.sense_counts.select("word_id", sense_count(pi).alias("senses"))


for _name in ("expected_pi", "expected_logpi", "sense_count"):
    _catalogue[_name] = _catalogue.pop(f"{_name}_")


@query
def beta_means(f: Fixture) -> DataFrame:
    a, b = F.col("counts")[0] + 1.0, F.col("counts")[1] + ALPHA
    values = {
        "mean": X.mean_beta(a, b),
        "meanlog": X.meanlog_beta(a, b),
        "mirror": X.mean_mirror(a, b),
        "mirrorlog": X.meanlog_mirror(a, b),
    }
    return f.model.sense_counts.select("word_id", *[F.round(v, 8).alias(k) for k, v in values.items()])


@query
def sigmoids(f: Fixture) -> DataFrame:
    rows = f.embeddings().select("word_id", F.posexplode("vec").alias("i", "e"))
    x = F.col("e").cast("double") * 100
    return rows.select(
        "word_id", "i", F.round(X.sigmoid(x), 8).alias("sigmoid"), F.round(X.log_sigmoid(x), 8).alias("log_sigmoid")
    )


@query
def softmax(f: Fixture) -> DataFrame:
    scaled = F.transform("vec", lambda e: e.cast("double") * 100)
    return _cells(f.embeddings().select("word_id", X.softmax(scaled).alias("vec")), "word_id", digits=8)


@query
def log_skip_gram(f: Fixture) -> DataFrame:
    scored = S.pair_loglik(f.pair_counts(), f.model, f.decoder)
    return scored.select("x", "y", *_wide(scored, "ll", "ll"))


@query
def context_loglik(f: Fixture) -> DataFrame:
    scored = S.context_loglik(f.occurrences(), f.model, f.decoder)
    return scored.select("occ_id.*", "sense", rounded("ll"))


@query
def unit_vector(f: Fixture) -> DataFrame:
    rows = f.embeddings().select("word_id", X.unit(F.col("vec")).alias("vec"))
    return _cells(rows, "word_id", digits=8)


@query
def cos_dist(f: Fixture) -> DataFrame:
    a = f.embeddings().select("word_id", F.col("vec").alias("a"))
    b = f.embeddings().select((F.col("word_id") - 1).alias("word_id"), F.col("vec").alias("b"))
    return a.join(b, "word_id").select("word_id", F.round(X.cos_dist(F.col("a"), F.col("b")), 8).alias("distance"))


@query
def sense_vector(f: Fixture) -> DataFrame:
    words = f.stop_words().withColumn("sense", F.explode(F.array(F.lit(1), F.lit(2))))
    found = M.sense_vector(f.model, words)
    cells = found.select("word", "sense", F.posexplode(F.arrays_zip("vec", "unit")).alias("i", "e"))
    return cells.select(
        "word",
        "sense",
        "i",
        F.round(F.col("e.vec").cast("double"), 6).alias("value"),
        F.round(F.col("e.unit"), 6).alias("unit"),
    )


@query
def model_shape(f: Fixture) -> DataFrame:
    return M.model_shape(f.model)


# --- training -----------------------------------------------------------------------------------------------


def _wide_posterior(z: DataFrame) -> DataFrame:
    return z.select("occ_id.*", *_wide(z, "z", "z"))


@query
def train_posterior(f: Fixture) -> DataFrame:
    return _wide_posterior(R.train_posteriors(f.occurrences(), f.model, f.decoder))


def _round(f: Fixture) -> DataFrame:
    return R.model_sums(f.occurrences(), f.model, LR, THRESHOLD, f.decoder)


@query
def gradient_round(f: Fixture) -> DataFrame:
    sums = materialize(_round(f), "sums")
    in_vec, out_vec = R.apply_gradients(f.model, sums, CAP)
    rows = in_vec.select(F.lit("in").alias("side"), F.col("word_id").alias("id"), "sense", "vec").unionByName(
        out_vec.select(F.lit("out").alias("side"), F.col("node_id").alias("id"), F.lit(0).alias("sense"), "vec")
    )
    return _cells(rows, "side", "id", "sense", digits=5)


@query
def update_counts(f: Fixture) -> DataFrame:
    counts = R.apply_counts(f.model, _round(f), LR)
    return counts.select("word_id", *_wide(counts, "counts", "c", 5))


@query
def ordered_counts(f: Fixture) -> DataFrame:
    """Counts after one update per occurrence, in reading order."""
    occ = _ordered(f).select("occ_id", "x", "ctx", "behind")
    counts = R.apply_ordered_counts(f.model, R.model_sums(occ, f.model, LR, THRESHOLD, f.decoder), LR)
    return counts.select("word_id", *_wide(counts, "counts", "c", 5))


@query
def lr_schedule(f: Fixture) -> DataFrame:
    """Rate at the start of each round when the languages are read one after the other, twice."""
    docs = f.table("documents").select("doc_id", "lang")
    # tokens of a document are counted where they are; one row per document meets its language
    of_docs = f.tokens().groupBy("doc_id").agg(F.count("*").alias("n"))
    sizes = of_docs.join(docs, "doc_id").groupBy("lang").agg(F.sum("n").alias("n"))
    rounds = V.repeat_epochs(sizes, 2)
    # one row per language and epoch
    before = W.orderBy("epoch", "lang").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    rows = rounds.withColumn("read", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(every))
    rate = R.learning_rate(F.col("read"), F.col("total"), LR)
    return rows.select("epoch", "lang", "read", F.round(rate, 9).alias("rate"))


TRAINING = TrainParams(window=WINDOW, min_freq=MIN_FREQ, dim=DIM, senses=SENSES, rounds=4)


def _trained(f: Fixture):
    docs = f.documents().select("doc_id", T.simple_tokenize(F.col("text")).alias("text"))
    return train(docs, TRAINING)


@query
def train_(f: Fixture) -> DataFrame:
    model = _trained(f).current()
    return M.sense_inventory(model, 1e-3).select("word", "sense", rounded("p"))


_catalogue["train"] = _catalogue.pop("train_")


@query
def train_loglik(f: Fixture) -> DataFrame:
    return _trained(f).metrics().select("epoch", "round", "pairs", rounded("mean_ll"))


@query
def round_metrics(f: Fixture) -> DataFrame:
    exact = ["epoch", "round", "occurrences", "pairs", "max_senses"]
    return _trained(f).metrics().select(
        *exact, rounded("lr", 9), rounded("mean_ll"), rounded("mean_senses"), rounded("share_read", 9)
    )


# --- model queries ------------------------------------------------------------------------------------------


@query
def disambiguate(f: Fixture) -> DataFrame:
    return _wide_posterior(S.disambiguate(f.occurrences(), f.model, decoder=f.decoder))


@query
def disambiguate_no_prior(f: Fixture) -> DataFrame:
    return _wide_posterior(S.disambiguate(f.occurrences(), f.model, use_prior=False, decoder=f.decoder))


@query
def disambiguate_words(f: Fixture) -> DataFrame:
    at = F.col("position") + 1
    first = F.greatest(at - WSI_WINDOW, F.lit(1))
    left = F.slice("ws", first, at - first)
    right = F.slice("ws", at + 1, F.lit(WSI_WINDOW))
    requests = f.instances().select(
        F.col("doc_id").alias("occ_id"), F.substring_index("key", ".", 1).alias("word"), F.concat(left, right).alias("context")
    )
    z = S.disambiguate_words(materialize(requests, "requests"), f.model)
    return z.select(F.col("occ_id").alias("doc_id"), *_wide(z, "z", "z"))


@query
def nearest_to_vector(f: Fixture) -> DataFrame:
    """Neighbours of the mean of all vectors."""
    vectors = f.embeddings()
    width = vectors.select(F.size("vec")).first()[0]
    mean = vectors.agg(F.array(*[F.avg(F.col("vec")[i].cast("double")) for i in range(width)]).alias("m")).first()["m"]
    return N.nearest_to_vector(N.candidates(vectors), mean, 10).select("word_id", "sense", rounded("sim"))


@query
def nearest_neighbors(f: Fixture) -> DataFrame:
    """Neighbours, among all senses of the model, of the first sense of the most frequent word."""
    rows = N.candidates(f.model.in_vec, f.model.sense_counts, 1.0)
    return N.nearest_neighbors(rows, 1, 1, 10).select("word_id", "sense", rounded("sim"))


@query
def nearest_neighbors_batch(f: Fixture) -> DataFrame:
    vectors = N.candidates(f.embeddings())
    best = N.nearest_neighbors_batch(vectors, vectors, 10)
    return best.select("query_id", "rank", "word_id", rounded("sim"))


@query
def likelihood_by_doc(f: Fixture) -> DataFrame:
    # counted where the windows were built; parts of a document are summed with the rest
    counted = C.pair_counts(f.pairs(), "doc_id", "chunk_id")
    by_doc = S.likelihood_by(counted, f.model, "doc_id", decoder=f.decoder, groups=f.table("documents"))
    return by_doc.select("doc_id", rounded("mean"), "n")


@query
def likelihood(f: Fixture) -> DataFrame:
    # counted where the windows were built; a pair may come once per chunk
    counted = C.pair_counts(f.pairs(), "doc_id", "chunk_id")
    return S.likelihood(counted, f.model, decoder=f.decoder).select(rounded("mean"), "n")


@query
def parallel_likelihood(f: Fixture) -> DataFrame:
    counted = C.pair_counts(f.pairs(WSI_WINDOW, LIKELIHOOD_BATCH), "doc_id", "chunk_id")
    stats = S.likelihood_by(counted, f.model, "doc_id", "chunk_id", min_prob=0.005, decoder=f.decoder)
    return S.merge_means(stats).select(rounded("mean"), "n")


@query
def likelihood_log(f: Fixture) -> DataFrame:
    """The log of batch means, written and read back."""
    pairs = C.pair_counts(f.pairs(WSI_WINDOW, LIKELIHOOD_BATCH), "doc_id", "chunk_id")
    stats = S.likelihood_by(pairs, f.model, "doc_id", "chunk_id", min_prob=0.005, decoder=f.decoder)
    return materialize(stats, "likelihood-log").select("doc_id", "chunk_id", rounded("mean"), "n")


@query
def nearest_words(f: Fixture) -> DataFrame:
    """Neighbours of the most frequent word, by words."""
    word = f.vocab.filter("word_id = 1").first()["word"]
    return N.nearest_words(f.model, word, 1).select("word", "sense", rounded("sim"))


@query
def sense_inventory(f: Fixture) -> DataFrame:
    return M.sense_inventory(f.model).select("word", "sense", rounded("p"))


@query
def argmax_sense(f: Fixture) -> DataFrame:
    best = S.argmax_sense(S.disambiguate(f.occurrences(), f.model, decoder=f.decoder))
    return best.select("occ_id.*", "sense")


# --- evaluation ---------------------------------------------------------------------------------------------


@query
def wsi_predict(f: Fixture) -> DataFrame:
    return wsi.predict(f.instances(), f.model, WSI_WINDOW, f.decoder)


@query
def wwsi_contingency(f: Fixture) -> DataFrame:
    rows = _weighted_rows(f)
    return wsi.weighted_contingency(rows, f.model, WSI_WINDOW, f.stop_words(), decoder=f.decoder)


@query
def wwsi_record_cells(f: Fixture) -> DataFrame:
    """Contingency by record and number of the sense, from the nested files."""
    rows = NS.read_nested(f.spark, f.nested_file)
    cells = wsi.weighted_contingency(rows, f.model, WSI_WINDOW, f.stop_words(), decoder=f.decoder)
    return cells.select("word", "truth", "pred", "n")


@query
def wwsi_mean_ari(f: Fixture) -> DataFrame:
    scored = wsi.mean_ari(_weighted_rows(f), f.model, WSI_WINDOW, f.stop_words(), decoder=f.decoder)
    return scored.select("words", rounded("mean_ari"))


@query
def ari(f: Fixture) -> DataFrame:
    labels = f.table("labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred"))
    return E.ari(labels).select(rounded("ari"))


@query
def ari_by_key(f: Fixture) -> DataFrame:
    return E.ari_by_key(f.labels(), "key").select("key", rounded("ari", 8))


@query
def v_measure(f: Fixture) -> DataFrame:
    return E.v_measure(f.labels(), "key").select("key", rounded("v", 8))


@query
def paired_fscore(f: Fixture) -> DataFrame:
    return E.paired_fscore(f.labels(), "key").select("key", rounded("f", 8))


@query
def wsi_summary(f: Fixture) -> DataFrame:
    truth = f.labels().select("dataset", "key", "instance", F.col("truth").alias("sense"))
    pred = f.labels().select("dataset", "key", "instance", F.col("pred").alias("sense"))
    labels = E.align(truth, pred, "dataset")
    out = E.summary(labels, "key", "dataset")
    return out.select("dataset", "one_sense_keys", *[rounded(c, 8) for c in out.columns if "mean" in c or "weighted" in c])


@query
def compensated_sum(f: Fixture) -> DataFrame:
    sums = K.compensated_sum(f.table("lineitem"), "l_returnflag", "l_extendedprice")
    return sums.select("l_returnflag", rounded("total", 2), "n")


@query
def stable_mean(f: Fixture) -> DataFrame:
    return K.stable_mean(f.table("lineitem"), "l_linestatus", "l_extendedprice").select(
        "l_linestatus", rounded("mean"), "n"
    )


@query
def merge_means(f: Fixture) -> DataFrame:
    """Means of every order merged into means per return flag."""
    batches = f.table("lineitem").groupBy("l_returnflag", "l_orderkey").agg(
        F.avg("l_quantity").alias("mean"), F.count("*").alias("n")
    )
    return S.merge_means(batches, "l_returnflag").select("l_returnflag", rounded("mean"), "n")


# --- streams ------------------------------------------------------------------------------------------------


@query
def stream_word_count(f: Fixture) -> DataFrame:
    return stream_counts.count_available(f.spark, f.folder, "documents.parquet")


@query
def stream_disambiguate(f: Fixture) -> DataFrame:
    z = stream_score.score_available(f.spark, f.occurrences(), f.model, f.decoder)
    return _wide_posterior(z)
