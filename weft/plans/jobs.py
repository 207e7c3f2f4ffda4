"""User-facing composite jobs (K1-K11): chains of the operators over the
user's own tables.  The driver queries in ``q_*.py`` run the same chains on
tables derived from the driver data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import chat, jsonx, mcq
from weft.functions.text import after_think, error_class, normalize_category, question_id
from weft.operators import classify, dedup, genmetrics, quota, trainset, translate, usage, validate
from weft.operators.ordering import row_number_within
from weft.session import scratch_path
from weft.sources.commits import Commit, CommitLog
from weft.sources.tables import dealt


def plan_generation(spark: SparkSession, source: DataFrame, existing: DataFrame,
                    categories: list[str], total: int, chunk_size: int = 10,
                    min_batch: int = 3, max_batch: int = 10, model: str = "gpt-4o-mini",
                    temperature: float = 0.7, max_tokens: int = 4096,
                    template: str = "Targets:\n{targets}\nGenerate {num_to_generate}.") -> DataFrame:
    """K1: counts -> quota -> oversampled chunk plan -> batch sizes -> batch
    prompt -> request key.  ``source``: (question_id, category, question)."""
    q = quota.remaining_quota(spark, quota.category_counts(existing), categories, total)
    items = quota.oversample_plan(source, q, "question_id", chunk_size, id_col="question_id")
    need = q.select(F.col("category").alias("plan_category"), "remaining")
    items = items.join(need, "plan_category").withColumn(
        "batch_id", quota.batch_of_position(F.col("item_pos"), F.col("remaining"), min_batch, max_batch))
    src = source.select(F.col("question_id").alias("source_id"), F.col("question"))
    lines = items.join(src, "source_id")
    per = lines.groupBy("plan_category", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct("item_pos", "source_id", "question"))).alias("items"))
    targets = F.array_join(F.transform("items", lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), x["question"])), "\n")
    prompt = F.replace(F.replace(F.lit(template), F.lit("{targets}"), targets),
                       F.lit("{num_to_generate}"), F.size("items").cast("string"))
    return per.select("plan_category", "batch_id", F.size("items").alias("n_items"),
                      prompt.alias("prompt"),
                      usage.request_key(F.lit(model), prompt, temperature, max_tokens).alias("key"))


def ingest_responses(responses: DataFrame, script: str = "thai",
                     min_chars: int = validate.MIN_TURN_CHARS,
                     existing: DataFrame | None = None) -> DataFrame:
    """K2: (batch_id, category, text, source_ids array<string>) -> one row per
    parsed drill with id, source id and reason (null = accepted).  Ids go on
    after the rows of ``existing`` (column category): a second run repeats none."""
    el = responses.select("batch_id", "category", "source_ids",
                          F.posexplode(jsonx.extract_json_array("text")).alias("pos", "e"))
    el = el.where(jsonx.variant_kind("e") == "OBJECT")
    t = jsonx.get("e", "$.turns", "array<string>")
    ref = jsonx.get("e", "$.reference", "array<variant>")
    s = el.withColumn("turns", t).withColumn(
        "s_reason", validate.mtbench_structure_reason(F.col("turns"), ref, F.col("category")))
    ok = s.where(F.col("s_reason").isNull()).withColumn("_cat", normalize_category(F.col("category")))
    ok = row_number_within(ok, ["_cat"], ["batch_id", "pos"], out="_rn")
    if existing is not None:
        had = existing.groupBy(normalize_category(F.col("category")).alias("_had")).agg(F.count(F.lit(1)).alias("_n"))
        ok = ok.join(had, F.col("_cat").eqNullSafe(F.col("_had")), "left").withColumn(
            "_rn", F.col("_rn") + F.coalesce("_n", F.lit(0))).drop("_had", "_n")
    ok = ok.withColumn("question_id", question_id(F.col("category"), F.col("_rn") - 1)).drop("_cat", "_rn")
    out = ok.unionByName(s.where(F.col("s_reason").isNotNull())
                          .withColumn("question_id", F.lit(None).cast("string")))
    src = F.coalesce(F.try_element_at("source_ids", F.col("pos") + 1),
                     F.concat(F.lit("unknown_"), F.col("pos").cast("string")))
    reason = F.coalesce("s_reason", validate.mtbench_content_reason(F.col("turns"), script, min_chars))
    return out.select("batch_id", "pos", "category", "question_id", src.alias("source_question_id"),
                      "turns", reason.alias("reason"))


def deduplicate(df: DataFrame, key: str, order_col: str, threshold: int = 95) -> tuple[DataFrame, DataFrame]:
    """K4: exact + fuzzy dedup on ``key``; returns (kept rows, summary)."""
    kept, _ = dedup.fuzzy_dedup(df, key, order_col, [c for c in df.columns if c not in (key, order_col)],
                                threshold)
    total = df.agg(F.count(F.lit(1)).alias("n_original"))
    after = kept.agg(F.count(F.lit(1)).alias("n_after"))
    summary = total.unionByName(after, allowMissingColumns=True).agg(
        F.max("n_original").alias("n_original"), F.max("n_after").alias("n_after")) \
        .withColumn("n_removed", F.col("n_original") - F.col("n_after"))
    return kept.drop("n_copies"), summary


def training_set(drills: DataFrame, exam: DataFrame, max_len: int = 512, vocab: DataFrame | None = None) -> DataFrame:
    """K6: (conv_id, turns, reference) and generated exam records (item_id, line)
    -> one table of examples with token ids.  A drill gives an example per turn
    (with the turns before it) if each turn has a reference (F5, F6); an exam
    record one if its answer has an explanation (P13).  U1 joins both; ids are by
    ``vocab``, by default that of these examples (P31)."""
    d = drills.where((F.size("reference") > 0) & (F.size("turns") == F.size("reference")))
    x = d.select("conv_id", "turns", "reference", F.posexplode("turns").alias("n", "_t"))
    ours = x.select(F.concat(F.lit("drill-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("example_id"),
                    F.concat(chat.chatml_prompt("turns", "reference", F.col("n"), variant="generated"),
                             F.element_at("reference", F.col("n") + 1), F.lit("<|im_end|>\n")).alias("text"))
    user, _, answer = mcq.generated_exam_messages(F.col("v"))
    # Parsed and rendered once: a filter on plain columns would repeat both below them.
    said = exam.select("item_id", F.try_parse_json(F.col("line")).alias("v")).select(
        "item_id", F.inline(F.array(F.struct(user.alias("u"), answer.alias("a")))))
    theirs = said.where("u IS NOT NULL AND a IS NOT NULL").select(
        F.concat(F.lit("exam-"), F.col("item_id").cast("string")).alias("example_id"),
        F.concat(F.lit("<|im_start|>user\n"), F.col("u"), F.lit("<|im_end|>\n<|im_start|>assistant\n"), F.col("a"),
                 F.lit("<|im_end|>\n")).alias("text"))
    # Read three times (counts, places, result): parsed and rendered once, and dealt
    # out, as tasks are cut by bytes and an exam record costs far more for its bytes.
    spark, path = drills.sparkSession, scratch_path(drills.sparkSession, "training-set")
    dealt(ours.unionByName(theirs), "example_id").write.parquet(path)
    examples = spark.read.parquet(path)
    return trainset.encode(examples, "example_id", "text", vocab or trainset.vocabulary(examples, "text"), max_len)


def translate_dataset(entries: DataFrame, id_col: str, fields: list[str], responses: DataFrame,
                      done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K5: resume (J1 anti-join with done ids) -> units -> response join ->
    status -> re-assembled entries; U5 merges the earlier output with the new
    rows (by name).  Returns (output, audit).  The output has the entries that
    are ok or failed (a failed one keeps its original texts where the call
    failed); entries with pending units are not in it, so the next run takes
    them up again.  The audit has every entry that is not ok."""
    todo = entries.join(done.select(id_col), id_col, "left_anti") if done is not None else entries
    units = translate.explode_units(todo, id_col, fields)
    out = translate.apply_responses(units, responses, [id_col, "field", "pos"])
    assembled = translate.assemble(todo, out, id_col, fields)
    new = assembled.where(F.col("status").isin("ok", "failed"))
    merged = done.unionByName(new, allowMissingColumns=True) if done is not None else new
    return merged, assembled.where(F.col("status") != "ok")


def translate_run(log: CommitLog, run_id: str, entries: DataFrame, id_col: str, fields: list[str],
                  responses: DataFrame, order_col: str | None = None) -> Commit:
    """K5 as one commit of ``log``: the entries that no earlier run has settled are
    taken up (J1), and their outcome is written at once to

    * ``output``: ok and failed entries, translated, with their status (a failed
      one keeps its original texts where the call failed);
    * ``skipped``: entries that the content filter stopped, as they were (S11);
    * ``failed``: a row per failed unit with error, its class and the text (S11);
    * ``summary``: the run's entries by status, and all (A17).

    Pending entries are in ``summary`` alone, so a later run takes them up.  The
    same run id again changes nothing."""
    done = log.find(run_id)
    if done:
        return done
    todo = entries
    for settled in filter(None, (log.read("output"), log.read("skipped"))):
        todo = todo.join(settled.select(id_col), id_col, "left_anti")
    answered = translate.apply_responses(translate.explode_units(todo, id_col, fields), responses, [id_col, "field", "pos"], order_col)
    # Units and entries are read several times below: written once.
    path = scratch_path(log.spark, "translate-run")
    answered.write.parquet(f"{path}/units")
    units = log.spark.read.parquet(f"{path}/units")
    translate.assemble(todo, units, id_col, fields).write.parquet(f"{path}/entries")
    assembled = log.spark.read.parquet(f"{path}/entries")
    run = F.lit(run_id).alias("run_id")
    output = assembled.where(F.col("status").isin("ok", "failed")).select("*", run)
    skipped = todo.join(assembled.where("status = 'skipped'").select(id_col), id_col, "left_semi").select("*", run)
    lost = output.where("status = 'failed'").select(id_col)
    failed = units.where("unit_status = 'failed'").join(lost, id_col, "left_semi").select(
        id_col, "field", "pos", "error", error_class(F.col("error")).alias("error_class"), F.col("text").alias("failed_text"),
        F.lit("translation_max_retries_exceeded").alias("reason"), run)
    counts = assembled.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.lit("total").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    summary = counts.unionByName(total).select("status", "n", run)
    return log.commit(run_id, {"output": output, "skipped": skipped, "failed": failed, "summary": summary})


def score_multiple_choice(preds: DataFrame, golds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: (subset, item_id, response) + (subset, item_id, label) -> per-subset
    report and the unweighted mean accuracy.  Joined by item id."""
    letter = mcq.extract_answer_letter(after_think(F.col("response")))
    p = preds.select("subset", "item_id",
                     F.coalesce(mcq.label_id(letter), F.lit(mcq.COULD_NOT_ANSWER)).cast("bigint")
                     .alias("pred"))
    g = golds.select("subset", "item_id", mcq.label_id(F.col("label")).cast("bigint").alias("gold"))
    rep = classify.report(p.join(g, ["subset", "item_id"]), by=["subset"])
    return rep, classify.subset_mean(rep)


def score_judged(judgments: DataFrame) -> DataFrame:
    """K8: (question_id, turn, category, rating) -> mean per category (errors
    = -1 excluded and counted) plus the total as the mean of category means."""
    c = judgments.groupBy("category").agg(
        F.avg(F.when(F.col("rating") != -1, F.col("rating"))).alias("avg_rating"),
        F.count(F.lit(1)).alias("n_ratings"), F.count_if(F.col("rating") == -1).alias("n_errors"))
    tot = c.agg(F.lit("TOTAL").alias("category"), F.avg("avg_rating").alias("avg_rating"),
                F.sum("n_ratings").alias("n_ratings"), F.sum("n_errors").alias("n_errors"))
    return c.unionByName(tot)


def score_summaries(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref",
                    by: list[str] | None = None) -> DataFrame:
    """K9: all generation metrics for (hyp, ref) pairs."""
    return genmetrics.corpus_scores(genmetrics.pair_stats(pairs, hyp, ref), by=by or [])


def usage_report(calls: DataFrame) -> DataFrame:
    """(category, model, prompt_tokens, completion_tokens, total_tokens,
    is_cached) -> per category and total, with cost."""
    return usage.usage_rollup(calls)


__all__ = ["plan_generation", "ingest_responses", "deduplicate", "translate_dataset",
           "training_set", "translate_run", "score_multiple_choice", "score_judged", "score_summaries", "usage_report"]
