"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator key of the inventory. Outputs are reduced to comparable scalars
(id lists as md5 digests, doubles rounded to 6 places) with the same column
names as the DuckDB oracles in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenmill.functions.exprs import ids_digest, md5_key, round6, words_of
from tokenmill.operators import (codec, columns, decoding, examples, gate, order, profile,
                                 runlog, scoring, vocab)
from tokenmill.plans import fixtures as fx
from tokenmill.session import cut_lineage, scratch_path, table_path
from tokenmill.sources import io
from tokenmill.streaming import gate_stream

S, B, SEED = fx.SEQ_LEN, fx.BATCH_SIZE, fx.SEED


def _digest_pair(df, x="x", y="y"):
    return df.select("doc_id", ids_digest(x).alias("x_digest"), ids_digest(y).alias("y_digest"))


# ------------------------------------------------------------------ A: sources / sinks

def q_csv_roundtrip(spark, d):
    src = fx.table(spark, d, "documents").select("doc_id", "text", "lang")
    path = io.write_text_csv(src, scratch_path(spark, "csv"))
    back = io.read_text_csv(spark, path, columns=["doc_id", "text", "lang"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


def q_read_parquet(spark, d):
    return io.read_parquet(spark, table_path(d, "documents"), columns=["doc_id", "lang", "source", "n_chars"])


def q_prompt_lines(spark, d):
    path = io.write_lines(fx.prompts(spark, d), "text", scratch_path(spark, "prompts"))
    lines = io.read_lines(spark, path)
    return lines.select("line", F.length("line").cast("long").alias("n_chars"))


def _word_occurrences(spark, d):
    b = fx.table(spark, d, "benchmark")
    return b.select("item_id", F.posexplode(words_of("text")).alias("pos", "word"))


def q_word_list(spark, d):
    occ = _word_occurrences(spark, d).orderBy("item_id", "pos")
    path = scratch_path(spark, "wordlist")
    occ.select("word", F.col("item_id").cast("string").alias("item_id"),
               F.col("pos").cast("string").alias("pos")).write.options(header="true").csv(path)
    wl = io.read_word_list(spark, path)
    return wl.select("word", F.array_join("attrs", "|").alias("attrs"))


def q_load_splits(spark, d):
    return io.load_splits(fx.presplit(spark, d)).select("doc_id", "split")


def _split_ids(spark, d):
    return order.exact_split(fx.ids(spark, d).select("doc_id", "ids"), ["doc_id"], seed=SEED)


def q_write_splits(spark, d):
    path = io.write_splits(_split_ids(spark, d), scratch_path(spark, "splits"))
    back = io.read_splits(spark, path)
    return back.select("doc_id", "split", F.size("ids").cast("long").alias("n_ids"))


def q_write_splits_csv(spark, d):
    raw = io.load_splits(fx.presplit(spark, d))
    path = io.write_splits(raw, scratch_path(spark, "splits_csv"), format="csv")
    back = io.read_splits(spark, path, format="csv")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "split", F.md5("text").alias("text_md5"))


def q_saved_split_pairs(spark, d):
    """The training side's path: a saved split, its token column, its pairs."""
    path = io.write_splits(_split_ids(spark, d), scratch_path(spark, "saved_splits"))
    train = io.read_tokenized(spark, f"{path}/split=train")
    rows = train.select("doc_id", columns.token_column(train, "ids").alias("tokens"))
    return _digest_pair(examples.shift_pair(rows, S, fx.PAD_ID, ids="tokens"))


def q_land_if_absent(spark, d):
    path = scratch_path(spark, "landed")
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    io.land_if_absent(docs, path)
    io.land_if_absent(docs.filter(F.col("lang") == "en"), path)  # target exists: skipped
    return spark.read.parquet(path)


def _charvocab_model(spark, d):
    return codec.CodecModel.from_vocab(fx.charvocab(spark, d))


def _top1_batches(spark, d):
    lg = fx.logits(spark, d).withColumn("top1", scoring.argmax("logits"))
    return (lg.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "top1"))).alias("_p"))
            .select("batch_id", F.col("_p.top1").alias("preds")))


def q_prediction_log(spark, d, epoch: int = 0):
    model = _charvocab_model(spark, d)
    dec = codec.decode(_top1_batches(spark, d), model, ids="preds", out="text")
    lines = scoring.prediction_lines(dec, epoch)
    path = scratch_path(spark, "predlog")
    io.append_lines(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_export_vocab(spark, d):
    path = scratch_path(spark, "vocab_txt")
    io.export_vocab(fx.charvocab(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ------------------------------------------------------------------ B, C

def q_drop_id(spark, d):
    return columns.drop_columns_strict(fx.triples(spark, d).drop("conv_id"), "id")


def q_assemble_prompt(spark, d):
    return columns.assemble_prompt(fx.triples(spark, d)).select("id", "prompt")


def q_length_filter(spark, d):
    return columns.length_filter(fx.ids(spark, d)).select("doc_id", F.size("ids").cast("long").alias("n_ids"))


REMAP_FROM = ord("e") + 4  # a frequent id


def q_remap_token(spark, d):
    r = columns.remap_token(fx.ids(spark, d), "ids", REMAP_FROM, 32000)
    return r.select("doc_id", ids_digest("ids").alias("digest"),
                    F.size(F.filter("ids", lambda x: x == 32000)).cast("long").alias("n_remapped"))


def q_head_examples(spark, d):
    i = fx.ids(spark, d).withColumn("_h", md5_key(SEED, "doc_id"))
    head = columns.head_by(i, ["_h", "doc_id"], 201)
    pairs = examples.shift_pair(head, S, fx.PAD_ID)
    w = Window.orderBy("_h", "doc_id")  # over the 201 kept rows only
    return pairs.select((F.row_number().over(w) - 1).cast("long").alias("idx"), "doc_id",
                        ids_digest("x").alias("x_digest"), ids_digest("y").alias("y_digest"))


def q_union_corpora(spark, d):
    u = columns.union_all_by_name(fx.corpus_a(spark, d), fx.corpus_b(spark, d))
    return u.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


def q_combine_export(spark, d):
    a = fx.corpus_a(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    b = fx.corpus_b(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    back = columns.combine_and_export(spark, [a, b], scratch_path(spark, "combined_pq"),
                                      scratch_path(spark, "combined_csv"))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"),
                       "lang", "source")


# ------------------------------------------------------------------ D

def q_row_count(spark, d):
    return profile.row_count(fx.table(spark, d, "documents"))


def q_split_counts(spark, d):
    return profile.split_counts(_split_ids(spark, d))


def q_corpus_footprint(spark, d):
    return profile.corpus_footprint(fx.ids(spark, d))


def _lengths(spark, d):
    return profile.lengths(fx.ids(spark, d), "ids")


def q_length_summary(spark, d):
    s = profile.length_summary(_lengths(spark, d))
    return s.select([F.col(c) for c in s.columns])


def q_length_outliers(spark, d):
    return profile.length_outliers(_lengths(spark, d)).select("doc_id", "len")


def q_length_outliers_all(spark, d):
    n = profile.lengths(fx.ids(spark, d), "ids", filter=False)
    return profile.length_outliers(n).select("doc_id", "len")


def q_length_histogram(spark, d):
    h = profile.length_histogram(_lengths(spark, d))
    return h.select("bin", round6("lo").alias("lo"), round6("hi").alias("hi"), "n")


def q_epoch_metrics(spark, d):
    steps = fx.runlog_steps(spark, d).withColumn("train_loss_scaled", scoring.scaled_loss("train_loss", 1))
    m = profile.epoch_metrics(steps, ["val_loss", "train_loss_scaled"])
    return m.select("run", "epoch", round6("val_loss").alias("val_loss"),
                    round6("train_loss_scaled").alias("train_loss_scaled"), "n_steps")


def q_epoch_metrics_weighted(spark, d):
    """Weighted means of a loss, its perplexity and the loss scaled for three accumulation steps."""
    s = fx.runlog_steps(spark, d).withColumn("w", F.col("step") % 3 + 1)
    s = s.withColumn("val_perplexity", F.exp(F.col("val_loss") / 100)) \
        .withColumn("train_loss_scaled", scoring.scaled_loss("train_loss", 3))
    m = profile.epoch_metrics(s, ["val_loss", "val_perplexity", "train_loss_scaled"], weight="w")
    return m.select("run", "epoch", round6("val_loss").alias("val_loss"), round6("val_perplexity").alias("val_perplexity"),
                    round6("train_loss_scaled").alias("train_loss_scaled"), "n_steps")


# ------------------------------------------------------------------ E

def q_global_index(spark, d):
    return order.global_index(fx.text(spark, d).select("doc_id"), ["doc_id"], seed=SEED)


def q_exact_split(spark, d):
    return order.exact_split(fx.text(spark, d).select("doc_id"), ["doc_id"], seed=SEED)


def _shuffled(spark, d, cols=("doc_id",)):
    return order.epoch_shuffle(fx.ids(spark, d).select(*cols), ["doc_id"], fx.EPOCHS, seed=SEED)


def q_epoch_shuffle(spark, d):
    return _shuffled(spark, d).select("epoch", "doc_id", "pos")


def q_epoch_order_val(spark, d):
    v = order.epoch_shuffle(fx.text(spark, d).select("doc_id"), ["doc_id"], fx.EPOCHS, shuffle=False)
    return v.select("epoch", "doc_id", "pos")


def q_assign_batches(spark, d):
    return order.assign_batches(_shuffled(spark, d), B).select("epoch", "doc_id", "batch_id", "slot")


def q_rank_shards(spark, d, world_size: int = fx.WORLD_SIZE):
    g = order.global_index(fx.text(spark, d).select("doc_id"), ["doc_id"], seed=SEED, with_total="n")
    return order.rank_shards(g, world_size).select("doc_id", "global_pos", "rank", "rank_pos")


def q_rank_shards_wrap(spark, d):
    """Seven workers: the last positions wrap to the front."""
    return q_rank_shards(spark, d, 7)


def _sentences(spark, d):
    t = fx.text(spark, d)
    return (t.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .filter(F.trim("line") != ""))


def q_sample_sentences(spark, d, n: int = 1_000_000):
    s = order.sample_lines(_sentences(spark, d), ["doc_id", "line_no"], n, seed=SEED)
    return s.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "idx")


def q_sample_sentences_cut(spark, d):
    return q_sample_sentences(spark, d, 2000)


# ------------------------------------------------------------------ F

def q_normalise_text(spark, d):
    n = fx.norm(spark, d)
    return n.select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("n_chars"))


# Printable ASCII and its full-width forms, which NFKC folds back
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def q_normalise_wide(spark, d):
    """Full-width texts: NFKC gives the plain texts back."""
    wide = fx.text(spark, d).withColumn("text", F.translate("text", _ASCII, _WIDE))
    n = codec.normalise_text(wide, "text", "norm")
    return n.select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("n_chars"))


def q_normalise_trainer(spark, d):
    """Texts with zero-width blanks, byte-order marks and control characters put in, by the trainer's rule."""
    marked = F.col("text")
    for old, new in (("e ", "e\u200b \ufeff"), (", ", "\x01,\x7f\u2028"), ("th", "t\u200ch"), ("o", "o\x0b"), (".", ".\uff5e")):
        marked = F.replace(marked, F.lit(old), F.lit(new))
    n = codec.normalise_text(fx.text(spark, d).withColumn("text", marked), "text", "norm", rule="trainer")
    return n.select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("n_chars"))


def q_word_counts(spark, d):
    return vocab.word_counts(fx.norm(spark, d))


def q_seed_pieces(spark, d):
    return vocab.seed_pieces(vocab.word_counts(fx.norm(spark, d)))


def q_seed_pieces_top(spark, d):
    return vocab.seed_pieces(vocab.word_counts(fx.norm(spark, d)), top_k=5000)


def q_estep_counts(spark, d):
    """Expected counts of the best 2,000 seed pieces and all characters over all word types."""
    from tokenmill.operators import unigram
    v = fx.piecevocab(spark, d).filter("kind = 'normal'").select(F.col("id").cast("long").alias("pid"), "piece", "score")
    words = cut_lineage(vocab.word_counts(fx.norm(spark, d)).withColumn("wid", F.monotonically_increasing_id()))
    counts = unigram.expected_counts(unigram.build_lattice(words, v), v.select("pid", F.col("score").alias("logp")))
    return v.join(counts, "pid").select("piece", F.round("expected", 3).alias("expected"))


def q_train_vocab(spark, d, vocab_size: int = 1000):
    from tokenmill.operators import unigram
    v = unigram.train_vocab(fx.norm(spark, d), vocab_size=vocab_size)
    return v.select("id", "piece", round6("score").alias("score"), "kind")


def q_train_vocab_report(spark, d, vocab_size: int = 1000):
    """What any trained vocabulary must fulfil: dense ids, no more than asked
    for, and every character of the corpus a piece."""
    from tokenmill.operators import unigram
    n = fx.norm(spark, d)
    v = unigram.train_vocab(n, vocab_size=vocab_size)
    missing = vocab.char_pieces(n).join(v.filter("kind = 'normal'"), "piece", "left_anti")
    size = F.count(F.lit(1))
    return v.agg(((F.min("id") == 0) & (F.max("id") == size - 1) & (F.count_distinct("id") == size)).alias("dense"),
                 (size <= vocab_size).alias("fits"),
                 F.count(F.when((F.col("kind") == "normal") & (F.length("piece") == 1), 1)).alias("n_chars"),
                 missing.select(F.count(F.lit(1))).scalar().alias("n_missing"))


def q_train_vocab_full(spark, d):
    """The same report on a vocabulary of the reference configuration's size."""
    return q_train_vocab_report(spark, d, vocab_size=32_000)


def q_layout_vocab(spark, d):
    return fx.charvocab(spark, d)


def q_tokenizer_info(spark, d):
    return vocab.tokenizer_info(fx.charvocab(spark, d))


NEW_TOKENS = ["<SEP>", "<pad>", "▁the", "<SEP>"]


def q_add_tokens(spark, d):
    return vocab.add_tokens(fx.charvocab(spark, d), NEW_TOKENS)


def q_check_added(spark, d):
    old = cut_lineage(fx.charvocab(spark, d))
    new = vocab.add_tokens(old, NEW_TOKENS)
    return vocab.check_added(old, new, NEW_TOKENS)


def q_encode_added(spark, d):
    """Question and reply around an added separator, which is one id."""
    model = codec.CodecModel.from_vocab(vocab.add_tokens(fx.charvocab(spark, d), ["<SEP>"]))
    t = fx.triples(spark, d).select("id", F.concat("question", F.lit("<SEP>"), "response").alias("text"))
    sep = model.pieces["<SEP>"][0]
    return codec.encode(t, model, out="ids", bos=True, eos=True, drop_text=True).select(
        "id", F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda i: i == sep)).cast("long").alias("n_sep"),
        ids_digest("ids").alias("digest"))


def _encoded_docs(spark, d, model=None, bos=True, eos=True):
    model = model or _charvocab_model(spark, d)
    t = fx.text(spark, d)
    return codec.encode(t, model, text="text", out="ids", bos=bos, eos=eos, drop_text=True, partitions=fx.splits(t))


def _piece_model(spark, d):
    return codec.CodecModel.from_vocab(fx.piecevocab(spark, d))


def q_encode_pieces(spark, d):
    """Best segmentation into pieces of several characters; ties go to the longer last piece."""
    e = _encoded_docs(spark, d, _piece_model(spark, d))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("digest"))


def q_decode_pieces(spark, d):
    model = _piece_model(spark, d)
    e = codec.decode(_encoded_docs(spark, d, model), model, ids="ids", out="decoded")
    return e.select("doc_id", F.md5("decoded").alias("text_md5"), F.length("decoded").cast("long").alias("n_chars"))


def q_encode_text(spark, d):
    e = _encoded_docs(spark, d)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("digest"))


def q_decode_ids(spark, d):
    model = _charvocab_model(spark, d)
    e = codec.decode(_encoded_docs(spark, d, model), model, ids="ids", out="decoded")
    return e.select("doc_id", F.md5("decoded").alias("text_md5"), F.length("decoded").cast("long").alias("n_chars"))


def q_round_trip(spark, d):
    model = _charvocab_model(spark, d)
    e = codec.decode(codec.encode(fx.text(spark, d), model, bos=True, eos=True, partitions=fx.splits(fx.text(spark, d))),
                     model, ids="ids", out="decoded")
    expect = F.trim(F.regexp_replace("text", r"\s+", " "))
    return e.select("doc_id", (F.col("decoded") == expect).alias("ok"), F.size("ids").cast("long").alias("n_tokens"))


def q_lookup_piece(spark, d):
    chars = (fx.table(spark, d, "benchmark").select(F.explode(F.split("text", "")).alias("piece"))
             .filter(F.col("piece") != "").distinct())
    return vocab.lookup_piece(chars, fx.charvocab(spark, d)).select("piece", "id")


def q_lookup_id(spark, d):
    top = fx.logits(spark, d).select("vec_id", scoring.argmax("logits").alias("id"))
    return vocab.lookup_id(top, fx.charvocab(spark, d)).select("vec_id", "id", "piece")


def q_tokenize_text(spark, d):
    docs = fx.text(spark, d)
    t = codec.tokenize_text(docs, _charvocab_model(spark, d), partitions=fx.splits(docs))
    return t.select("doc_id", F.size("Tokenized_Data").cast("long").alias("n_tokens"),
                    ids_digest("Tokenized_Data").alias("digest"))


def q_tokenize_triples(spark, d):
    t = codec.tokenize_triples(fx.triples(spark, d), _charvocab_model(spark, d))
    return t.select("id", F.size("Tokenized_Data").cast("long").alias("n_tokens"),
                    ids_digest("Tokenized_Data").alias("digest"))


def _split_summary(back):
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum(F.size("Tokenized_Data")).cast("long").alias("n_tokens"))


def q_tokenize_and_split(spark, d):
    docs = fx.text(spark, d)
    tok = codec.tokenize_text(docs, _charvocab_model(spark, d), length_col="n_tokens", partitions=fx.splits(docs))
    # written once: the split reads the tokens twice (counts + rows)
    tok_path = scratch_path(spark, "tokenized")
    tok.write.parquet(tok_path)
    split = order.exact_split(spark.read.parquet(tok_path), ["doc_id"], seed=SEED)
    path = io.write_splits(split, scratch_path(spark, "tok_splits"))
    return _split_summary(io.read_splits(spark, path))


def q_tokenize_presplit(spark, d):
    model = _charvocab_model(spark, d)
    raw = io.load_splits(fx.presplit(spark, d))
    tok = codec.tokenize_text(raw, model)
    path = io.write_splits(tok, scratch_path(spark, "presplit"))
    return _split_summary(io.read_splits(spark, path))


# ------------------------------------------------------------------ G

def q_pad_or_cut(spark, d):
    p = examples.pad_or_cut(fx.ids(spark, d), S, fx.PAD_ID)
    return p.select("doc_id", F.size("padded").cast("long").alias("n_padded"), ids_digest("padded").alias("digest"),
                    F.size(F.filter("padded", lambda x: x == fx.PAD_ID)).cast("long").alias("n_pad"))


def q_shift_pair(spark, d):
    """Flagship: text → character vocabulary → encode(bos, eos) → pairs."""
    pairs = examples.shift_pair(_encoded_docs(spark, d), S, fx.PAD_ID)
    return _digest_pair(pairs)


def q_loss_tokens(spark, d):
    pairs = examples.shift_pair(fx.ids(spark, d), S, fx.PAD_ID, keep_ids=True)
    lt = examples.loss_tokens(pairs, S, fx.PAD_ID)
    return lt.select("doc_id", "n_targets", round6("pad_share").alias("pad_share"), "n_cut")


def q_check_examples(spark, d):
    return examples.check_examples(examples.shift_pair(fx.ids(spark, d), S, fx.PAD_ID), S)


def q_build_batches(spark, d):
    bb = examples.epoch_batches(fx.ids(spark, d), ["doc_id"], fx.EPOCHS, B, S, fx.PAD_ID, seed=SEED)
    return bb.select("epoch", "batch_id", "n_pairs", F.array_join("doc_id", ",").alias("doc_ids"),
                     ids_digest(F.flatten("x")).alias("x_digest"), ids_digest(F.flatten("y")).alias("y_digest"))


# ------------------------------------------------------------------ I

def q_softmax(spark, d, temperature: float = 0.7):
    lg = fx.logits(spark, d).withColumn("probs", scoring.softmax("logits", temperature))
    return lg.select("vec_id", round6(F.array_max("probs")).alias("p_max"),
                     round6(F.element_at("probs", F.col("target") + 1)).alias("p_target"),
                     round6(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)).alias("p_sum"))


def _batch_losses(spark, d):
    return scoring.cross_entropy(fx.logits(spark, d), by=("batch_id",), pad_id=fx.PAD_ID)


def q_cross_entropy(spark, d):
    return _batch_losses(spark, d).select("batch_id", round6("loss").alias("loss"), "n_targets")


def q_perplexity(spark, d):
    p = scoring.perplexity(_batch_losses(spark, d))
    return p.select("n_batches", round6("val_loss").alias("val_loss"), round6("val_perplexity").alias("val_perplexity"))


def q_top1(spark, d):
    return fx.logits(spark, d).select("vec_id", decoding.greedy_token("logits").alias("top1"))


# ------------------------------------------------------------------ J

def _encoded_prompts(spark, d, model=None):
    model = model or _charvocab_model(spark, d)
    return decoding.encode_prompts(fx.prompts(spark, d), model, S, fx.MAX_GEN_LEN, batch_size=B)


def q_encode_prompts(spark, d):
    e = _encoded_prompts(spark, d)
    return e.select("prompt_id", "batch_id", "n_input", "min_len", "max_len", "total_len",
                    ids_digest("ids").alias("digest"))


def q_prompt_matrix(spark, d):
    m = decoding.prompt_matrix(_encoded_prompts(spark, d), fx.PAD_ID)
    return m.select("prompt_id", F.size("tokens").cast("long").alias("n_tokens"), ids_digest("tokens").alias("digest"),
                    F.size(F.filter("is_prompt", lambda x: x)).cast("long").alias("n_prompt"))


def q_batch_guard(spark, d):
    return decoding.batch_guard(fx.prompts(spark, d), B)


def q_repetition_penalty(spark, d):
    lg = fx.logits(spark, d).withColumn("pen", decoding.repetition_penalty("logits", fx.context_ids(),
                                                                            fx.REPETITION_PENALTY))
    return lg.select("vec_id", round6(F.aggregate("pen", F.lit(0.0), lambda a, v: a + v)).alias("pen_sum"),
                     scoring.argmax("pen").alias("pen_top1"),
                     round6(F.element_at("pen", F.col("target") + 1)).alias("pen_target"))


def _kept(spark, d, temperature: float = 1.0):
    lg = fx.logits(spark, d).withColumn("probs", scoring.softmax("logits", temperature))
    return decoding.nucleus_filter(lg, ["vec_id"], fx.TOP_P)


def q_nucleus_filter(spark, d):
    k = _kept(spark, d)
    return k.select("vec_id", "token_id", round6("p").alias("p"), F.col("rank").cast("long").alias("rank"))


def q_sample_token(spark, d):
    lg = fx.logits(spark, d).withColumn("probs", scoring.softmax("logits", 1.0))
    return decoding.sample_nucleus(lg, ["vec_id"], fx.TOP_P, seed=SEED, step=0)


def q_force_prompt(spark, d):
    """The step's candidate is the prompt's own next id: its reply's, or eos."""
    model = _charvocab_model(spark, d)
    m = decoding.prompt_matrix(_encoded_prompts(spark, d, model), fx.PAD_ID).withColumn("cur_pos", F.col("min_len"))
    own = _completed(spark, d, model).select("prompt_id", F.col("tokens").alias("_own"))
    j = m.join(own, "prompt_id", "left") \
        .withColumn("candidate", F.try_element_at("_own", (F.col("cur_pos") + 1).cast("int")))
    nxt = decoding.force_prompt("tokens", "is_prompt", "cur_pos", "candidate")
    return j.select("prompt_id", "cur_pos", nxt.cast("int").alias("token"),
                    F.try_element_at("is_prompt", (F.col("cur_pos") + 1).cast("int")).alias("forced"))


def _completed(spark, d, model=None):
    """Prompt + reply sequences: ``encode(question, bos) ++ encode(response) ++ [eos]``."""
    model = model or _charvocab_model(spark, d)
    t = fx.triples(spark, d)
    q = codec.encode(t.select("id", "conv_id", "question", "response"), model, text="question", out="q_ids", bos=True)
    r = codec.encode(q, model, text="response", out="r_ids")
    eos = model.special["eos"]
    return r.select(F.col("id").alias("prompt_id"), F.expr("conv_id div 4").alias("batch_id"),
                    F.size("q_ids").cast("long").alias("n_input"),
                    F.concat("q_ids", "r_ids", F.array(F.lit(eos))).alias("tokens"))


STOP_PIECES = [".", "!"]
STOP_WORDS = ["the"]


def q_stop_ids(spark, d):
    model = _charvocab_model(spark, d)
    ids = [model.pieces[p][0] for p in STOP_PIECES if p in model.pieces]
    return decoding.stop_on_ids(_completed(spark, d, model), ids)


def q_stop_words(spark, d):
    model = _charvocab_model(spark, d)
    return decoding.stop_on_words(_completed(spark, d, model), model, STOP_WORDS, fx.PAD_ID, model.special["eos"])


def _trimmed(spark, d):
    model = _charvocab_model(spark, d)
    return decoding.trim_and_count(_completed(spark, d, model), fx.MAX_GEN_LEN, fx.PAD_ID, model.special["eos"])


def q_trim_and_count(spark, d):
    t = _trimmed(spark, d)
    return t.select("prompt_id", "n_generated", ids_digest("trimmed").alias("digest"))


def q_generation_report(spark, d):
    return decoding.generation_report(_trimmed(spark, d), "prompt_id")


# ------------------------------------------------------------------ H

def q_split_words(spark, d):
    w = gate.split_words(fx.prompts(spark, d))
    return w.select("prompt_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


def q_out_of_vocab(spark, d):
    w = gate.split_words(fx.prompts(spark, d))
    o = gate.out_of_vocab(w, fx.words(spark, d), "prompt_id")
    return o.select("prompt_id", F.array_join("missing", " ").alias("missing"))


def q_flag_prompts(spark, d):
    f = gate.flag_prompts(fx.prompts(spark, d), fx.words(spark, d), "prompt_id")
    return f.select("prompt_id", "status", "n_missing")


def _gate_sink(spark, d):
    src = scratch_path(spark, "gate_src")
    p = fx.prompts(spark, d)
    # land the prompts as several files so the stream sees several micro-batches
    p.repartition(4, "batch_id").write.parquet(src)
    sink, ckpt = scratch_path(spark, "gate_sink"), scratch_path(spark, "gate_ckpt")
    q = gate_stream.start_gate_stream(spark, src, p.schema, fx.words(spark, d), sink, ckpt, "prompt_id",
                                      max_files_per_trigger=1, every=B)
    q.awaitTermination()
    return gate_stream.read_gate_sink(spark, sink)


def q_flag_stream(spark, d):
    return _gate_sink(spark, d).select("prompt_id", "status", "n_missing")


def q_flag_stream_progress(spark, d):
    return gate_stream.gate_progress(_gate_sink(spark, d), B)


def q_stopword_coverage(spark, d):
    s = gate.stopword_coverage(fx.stop(spark, d), fx.words(spark, d))
    return s.select("n_stop", "n_missing", F.array_join("missing", " ").alias("missing"))


def q_list_size(spark, d):
    return gate.list_size(fx.words(spark, d))


# ------------------------------------------------------------------ K

def q_lr_schedule(spark, d):
    ep = fx.runlog(spark, d).select("epoch").distinct()
    return runlog.lr_schedule(ep, fx.LR, fx.GAMMA).select("epoch", F.round("lr", 12).alias("lr"))


def q_best_checkpoints(spark, d):
    b = runlog.best_checkpoints(fx.runlog(spark, d), fx.TOP_K_CKPT)
    return b.select("run", "epoch", round6("val_loss").alias("val_loss"), F.col("rank").cast("long").alias("rank"))


def q_early_stop(spark, d):
    return runlog.early_stop_epoch(fx.runlog(spark, d), fx.PATIENCE)


def q_checkpoint_name(spark, d):
    b = runlog.best_checkpoints(fx.runlog(spark, d), fx.TOP_K_CKPT)
    return runlog.checkpoint_name(b).select("run", "epoch", "ckpt_name")


def q_checkpoint_path(spark, d):
    b = runlog.best_checkpoints(fx.runlog(spark, d), fx.TOP_K_CKPT)
    return runlog.checkpoint_path(b, "checkpoints").select("run", "epoch", "ckpt_path")


def q_run_stamp(spark, d):
    return runlog.run_stamp(fx.table(spark, d, "events")).select("event_id", "stamp")


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
