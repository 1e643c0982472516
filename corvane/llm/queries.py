"""The pN_ queries over the tables of TESTDATA.md, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.runtime import materialize, one_per_key, table, uniform_label

TOP = 5
ARTICLE_LIMIT, ARTICLE_OVERLAP = 600, 60
UNIT_LIMIT, UNIT_OVERLAP = 300, 30


def p1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed records of every plan in order, with the actual share of each record's slice."""
    from corvane.llm import mixing

    records, targets = mixing.plan_inputs(table(spark, sf_dir, "sft_candidate"), table(spark, sf_dir, "clean_scale_plan"))
    mixed = materialize(mixing.mix(records, targets), "mixed")
    shares = mixing.report(mixed, targets).select("plan", "source", "target_share", "actual_share")
    # One plan's slice may hold a third of the mix: its rows are spread by a salt, and its one share is given to each.
    salts = 16
    shares = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = mixed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(shares, ["plan", "source", "salt"])
    return out.select(F.col("plan").alias("plan_id"), F.col("position").cast("long").alias("position"), F.col("source").alias("slice"), "id", "use", "target_share", "actual_share")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import mixing

    records, targets = mixing.plan_inputs(table(spark, sf_dir, "sft_candidate"), table(spark, sf_dir, "clean_scale_plan"))
    shares = mixing.report(mixing.mix(records, targets), targets)
    return shares.filter("filled < target").select(F.col("plan").alias("plan_id"), F.col("source").alias("slice"))


def p2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and tokens by slice: of legal_article by source_type and department, of documents by source, lang and domain."""
    from corvane.llm.token_budget import budget, count_tokens

    art = count_tokens(table(spark, sf_dir, "legal_article"), ["article_id", "source_type", "department"], "content")
    art = one_per_key(art, "article_id").select(F.lit("legal_article").alias("tab"), F.coalesce(uniform_label(F.col("source_type")), F.lit("legal_regulation")).alias("source"), F.trim("department").alias("department"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("domain"), "n_tokens")
    doc = count_tokens(table(spark, sf_dir, "documents"), ["source", "lang", "domain"], "text")
    doc = doc.select(F.lit("documents").alias("tab"), uniform_label(F.col("source")).alias("source"), F.lit(None).cast("string").alias("department"), uniform_lang(F.col("lang")).alias("lang"), F.trim("domain").alias("domain"), "n_tokens")
    return budget(art.unionByName(doc), ["tab", "source", "department", "lang", "domain"])


def uniform_lang(column):
    """Two letters for the forms of a language tag: case, blanks, region and the three-letter codes of the table go."""
    short = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]+)", 1)
    return F.when(short == "zho", "zh").when(short == "eng", "en").when(short == "", F.lower(F.trim(column))).otherwise(short)


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each query and leg, with score and rank."""
    from corvane.llm.topn import top_n_per_group

    return top_n_per_group(table(spark, sf_dir, "ranked_hit"), ["query_id", "leg"], "chunk_id", "score", TOP)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_top(spark, sf_dir).select("query_id", "leg", "chunk_id")


def _p4_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    art = table(spark, sf_dir, "legal_article")
    part = lambda df, kind, key, raw: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(raw).alias("raw"))
    texts = part(table(spark, sf_dir, "private_holdout"), "query_original", "id", "query_original").unionByName(part(art, "content", "article_id", "content"))
    return texts, part(art, "law_name", "article_id", "law_name"), part(table(spark, sf_dir, "law_register"), "law_name", "law_id", "law_name")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with the one form of all that look like it."""
    from corvane.llm.lookalike import canonical

    texts, names, _ = _p4_values(spark, sf_dir)
    return canonical(texts.unionByName(names)).select("kind", "key", "canonical")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.lookalike import same_look

    return same_look(*_p4_values(spark, sf_dir))


def _p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.overlap import same_questions

    hold = one_per_key(table(spark, sf_dir, "private_holdout").select(F.lit("holdout").alias("split"), F.col("id").alias("eval_id"), F.array("query_original", "query_formal").alias("forms"), F.col("retrieval_gt.required_chunk_ids").alias("required")), "eval_id")
    case = one_per_key(table(spark, sf_dir, "evaluation_case").select(F.lower(F.trim("split")).alias("split"), F.col("query_id").alias("eval_id"), F.array("query_original", "query_formal").alias("forms"), F.col("required_chunk_ids").alias("required")), "eval_id")
    train = one_per_key(table(spark, sf_dir, "sft_candidate").select(F.col("id").alias("train_id"), F.col("query_original").alias("text"), F.col("required_chunk_ids").alias("required")), "train_id")
    return same_questions(hold.unionByName(case), train)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5_pairs(spark, sf_dir).select("split", "eval_id", "train_id")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked questions and the training records that hold them, by split and by source of the training records."""
    source = one_per_key(table(spark, sf_dir, "sft_candidate").select(F.col("id").alias("train_id"), uniform_label(F.col("source")).alias("source")), "train_id")
    pairs = _p5_pairs(spark, sf_dir).join(source, "train_id")
    return pairs.groupBy("split", "source").agg(F.countDistinct("eval_id").alias("questions"), F.countDistinct("train_id").alias("records"), F.count(F.lit(1)).alias("pairs"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized articles and units."""
    from corvane.llm.splitting import split_oversized

    art = split_oversized(table(spark, sf_dir, "legal_article"), "article", "article_id", "content", ARTICLE_LIMIT, ARTICLE_OVERLAP)
    return art.unionByName(split_oversized(table(spark, sf_dir, "evidence_unit"), "unit", "unit_id", "text", UNIT_LIMIT, UNIT_OVERLAP))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).filter("window_index = 0").select("kind", "item_key")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.encoding import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.leakage import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_item"), "doc_id", "text", "item_id", "text")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document that has readable text."""
    from corvane.llm.reading import reading_levels

    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"), "doc_id", "text", "doc_id", "reading_level")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).filter("reading_level = 4").select("doc_id")


def queries() -> dict:
    """Of each problem, the query of its cases first."""
    all_ = (p1_found, p1_mix, p2_tokens, p3_found, p3_top, p4_found, p4_forms, p5_found, p5_counts, p6_found, p6_pieces, p7_ids, p8_found, p9_found, p9_levels)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    from corvane.llm.oracle import SQL

    return SQL
