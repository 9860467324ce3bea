"""Training-example materialisation, the table-shaped half (survey section 2.12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.rand import hash_uniform
from tallgene.operators.setops import SPECIAL_TOKENS

IGNORE = -100
UNK = "[UNK]"


def _unk_id(vocab, field: str, id_col: str):
    return vocab.where((F.col("field") == field) & (F.col("token") == UNK)).select(F.max(id_col)).scalar()


def tokens_to_ids(rows, vocab, field: str, token: str, out: str = "token_id", id_col: str = "local_id") -> DataFrame:
    """mat_tokens_to_ids: id of a token in its field, unknown tokens take the [UNK] id."""
    ids = vocab.where(F.col("field") == field).select(F.col("token").alias(token), F.col(id_col).alias(out))
    return rows.join(ids, token, "left").withColumn(out, F.coalesce(out, _unk_id(vocab, field, id_col)))


def ids_to_tokens(rows, vocab, id_col: str = "global_id") -> DataFrame:
    """mat_ids_to_tokens: global ids back to field, token and local id."""
    return rows.join(vocab.select("global_id", "field", "token", "local_id"), id_col)


def token_values(vocab, field: str) -> DataFrame:
    """mat_token_values: whole-number value of every token; null for the whole field if more tokens than the
    special ones are not numbers."""
    rows = vocab.where(F.col("field") == field)
    num = rows.withColumn("value", F.when(F.col("token").rlike("^\\s*[-+]?[0-9]+\\s*$"), F.trim("token").cast("bigint").cast("double")))
    bad = num.where(F.col("value").isNull()).select(F.count("*")).scalar()
    return num.select("token", "local_id", F.when(bad <= len(SPECIAL_TOKENS), F.col("value")).alias("value"))


def pad_frame(samples, cls_id: int, sep_id: int, pad_id: int, max_length: int, multiple: int | None = None) -> DataFrame:
    """mat_pad_frame: [CLS] ids [SEP], cut to max_length, padded to the batch's longest (or a multiple), with mask."""
    body = F.slice("ids", 1, max_length - 2)
    framed = samples.withColumn("ids", F.concat(F.array(F.lit(cls_id)), body, F.array(F.lit(sep_id))))
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    if multiple:
        longest = F.ceil(longest / multiple) * multiple
    framed = framed.withColumns({"_n": F.size("ids"), "_len": longest.cast("int")})
    pads = F.col("_len") - F.col("_n")
    return framed.select(
        "cell_id", "batch_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pads)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), pads)).alias("attention"))


def unknown_rate(rows, unk_id: int, limit: float) -> DataFrame:
    """mat_unk_rate: share of [UNK] per sample and over all, compared with a limit."""
    is_unk = F.avg((F.col("token_id") == unk_id).cast("double"))
    per = rows.groupBy("cell_id").agg(is_unk.alias("unk_rate"))
    total = rows.agg(is_unk.alias("unk_rate")).withColumn("cell_id", F.lit("total"))
    return per.unionByName(total).withColumn("ok", F.col("unk_rate") <= limit)


def align_pretrained(vectors, vocab, field: str) -> DataFrame:
    """mat_pretrained_align: position of a pretrained vector and the vocabulary id it fills; unknown tokens drop out."""
    ids = vocab.where((F.col("field") == field) & (F.col("token") != UNK)).select("token", F.col("local_id").alias("freeze_id"))
    return vectors.select("token", "position").join(ids, "token")


def label_ids(obs, dictionary, col: str, silent: tuple[str, ...] = (), regression: bool = False) -> DataFrame:
    """mat_label_ids: class id or regression value; "nan", silent, missing and unknown labels become -100."""
    text = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    quiet = text.isin("nan", *silent)
    if regression:
        return obs.withColumn("label_value", F.when(quiet, F.lit(float(IGNORE))).otherwise(F.col(col).cast("double")))
    ids = dictionary.where(F.col("label_column") == col).select(F.col("label").alias(col), F.col("label_id").alias("_id"))
    joined = obs.join(ids, col, "left")
    return joined.withColumn("label_id", F.when(quiet | F.col("_id").isNull(), F.lit(IGNORE)).otherwise(F.col("_id"))).drop("_id")


def label_multihot(obs, labels: list[str], col: str, sep: str) -> DataFrame:
    """mat_label_multihot: 0/1 vector over the sorted label list; unknown parts are ignored."""
    parts = F.split(F.col(col), f"\\Q{sep}\\E")
    return obs.withColumn("multihot", F.array(*[F.array_contains(parts, name).cast("int") for name in labels]))


def label_ontology(obs, leaf_ids, closure, col: str) -> DataFrame:
    """mat_label_ontology: ids of the leaves under a label and whether there are any.

    ``closure`` holds (ancestor, node); the result is one row per cell with its sorted leaf ids, the
    sparse form of the 0/1 vector. Leaves are listed only below labels that some cell has.
    """
    asked = closure.join(obs.select(F.col(col).alias("ancestor")).distinct(), "ancestor", "left_semi")
    leaves = asked.join(leaf_ids.select(F.col("id").alias("node"), "label_id"), "node")
    per = leaves.groupBy(F.col("ancestor").alias(col)).agg(F.sort_array(F.collect_set("label_id")).alias("leaf_ids"))
    out = obs.join(per.hint("shuffle_hash"), col, "left").withColumn("leaf_ids", F.coalesce("leaf_ids", F.array().cast("array<int>")))
    return out.withColumn("has_leaves", (F.size("leaf_ids") > 0).cast("int"))


def mask_tokens(rows, change_ratio: float, mask_ratio: float, switch_ratio: float, mask_id: int, unk_id: int, n_special: int,
                vocab_size, comask: bool = False, seed=0) -> DataFrame:
    """mat_mask: masked-token examples over long rows (cell_id, batch_id, pos, field, token_id, special, weight).

    Chance = change_ratio x weight / mean weight of the (batch, field), clamped; specials never, and without
    co-masking neither positions where any field is masked or unknown. One draw per position (co-mask) or per
    position and field decides between [MASK], a random token, and keeping; unchanged positions have no label.
    """
    w = F.col("weight").cast("double")
    if not comask:
        odd = F.max(F.col("token_id").isin(mask_id, unk_id).cast("int")).over(Window.partitionBy("cell_id", "pos"))
        rows = rows.withColumn("_odd", odd)
        w = F.when(F.col("_odd") == 1, F.lit(0.0)).otherwise(w)
    rows = rows.withColumn("_w", w)
    mean = F.avg("_w").over(Window.partitionBy("batch_id", "field"))
    rows = rows.withColumn("_p", F.least(F.lit(1.0), F.col("_w") * change_ratio / mean))
    rows = rows.withColumn("_p", F.when(F.col("special"), F.lit(0.0)).otherwise(F.col("_p")))
    key = ["cell_id", "pos"] if comask else ["cell_id", "pos", "field"]
    rows = rows.withColumn("_u", hash_uniform(seed, *key))
    random_id = F.lit(n_special) + F.floor(hash_uniform(f"{seed}t", "cell_id", "pos", "field") * (vocab_size - n_special))
    p, u = F.col("_p"), F.col("_u")
    new = F.when(u <= p * mask_ratio, F.lit(mask_id)).when(u <= p * (mask_ratio + switch_ratio), random_id.cast("int")).otherwise(F.col("token_id"))
    return rows.select("cell_id", "batch_id", "pos", "field", new.cast("int").alias("input_id"),
                       F.when(u <= p, F.col("token_id")).alias("label_id"))


def pattern_weights(vocab, patterns: list[tuple[str, float]], field: str = "genes") -> DataFrame:
    """mat_mask_pattern_weights: weight 1 times the factor of every pattern that matches at the token's start."""
    factors = [F.when(F.col("token").rlike(f"^(?:{p})"), F.lit(float(w))).otherwise(F.lit(1.0)) for p, w in patterns]
    return vocab.where(F.col("field") == field).withColumn("weight", reduce(lambda a, b: a * b, factors, F.lit(1.0)))


def adaptive_weights(errors, col: str, n_bins: int, decreasing: bool = False) -> DataFrame:
    """mat_mask_adaptive: equal-width, right-closed bins of the error; weight (bin + 1) / (n + 1). One row per gene."""
    every = Window.partitionBy()
    e = F.max(col).over(every) - F.col(col) if decreasing else F.col(col)
    rows = errors.withColumn("_e", e)
    rows = rows.withColumns({"_lo": F.min("_e").over(every), "_w": (F.max("_e").over(every) - F.min("_e").over(every)) / n_bins})
    bin_ = F.least(F.greatest(F.ceil((F.col("_e") - F.col("_lo")) / F.col("_w")) - 1, F.lit(0)), F.lit(n_bins - 1))
    return rows.withColumn("weight", (bin_ + 1) / (n_bins + 1)).drop("_e", "_lo", "_w")


def wced_labels(all_rows, kept_rows, label_set: str) -> DataFrame:
    """mat_wced_labels: labels over the whole vocabulary; set = input, non_input or all of the cell's kept items."""
    kept = kept_rows.select("cell_id", "gene")
    if label_set == "input":
        return all_rows.join(kept, ["cell_id", "gene"], "left_semi")
    if label_set == "non_input":
        return all_rows.join(kept, ["cell_id", "gene"], "left_anti")
    if label_set == "all":
        return all_rows
    raise ValueError(f"unknown label set {label_set}")
