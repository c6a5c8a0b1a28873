"""The three reading modes, confidence fusion and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.chars import least_confidence, mean_confidence, raw_text
from glyphmill.operators.decode import decode, read_of
from glyphmill.operators.verify import verify


def fused(fsm: Column, sem: Column) -> Column:
    return F.when(fsm < C.FUSION_BOUND, F.least(fsm, sem)).otherwise(sem)


def gate(rows: DataFrame, theta: float | Column = C.GATE, conf: str = "conf", valid: str = "syntax_valid") -> DataFrame:
    """Adds is_approved, status and a reason code; confidence is compared at full precision."""
    level = theta if isinstance(theta, Column) else F.lit(theta)
    sure = F.col(conf) >= level
    ok = sure & F.col(valid)
    return rows.withColumn("is_approved", ok).withColumn("status", F.when(ok, "APPROVED").otherwise("FLAGGED")).withColumn("reason", F.when(ok, "passed").when(~sure, "confidence").otherwise("syntax"))


def mode_of(name: Column) -> Column:
    """Any name but the two others means tri_engine."""
    return F.when(name.isin("raw_cnn", "grammar_fsm"), name).otherwise("tri_engine")


def read_fields(fields: DataFrame, lexicon: DataFrame, theta: float = C.GATE, registry_substitution: bool = False, modes: tuple[str, ...] = C.MODES) -> DataFrame:
    """Predictions of the wanted modes: the hypotheses are decoded once and fanned out by an explode, not by a second pass.

    The raw mode alone needs no decoding, and the repair is made for the last mode only. latency_ms is for callers that
    measure single fields; a plan over many has none. A null reading is an empty one, in every mode.
    """
    hyp = F.col("hyp")
    kept = [c for c in fields.columns if c != "hyp"]
    ready = fields.select(*kept, read_of("hyp").alias("hyp")).select(*kept, "hyp", raw_text(hyp).alias("raw_text"), mean_confidence(hyp).alias("mean_conf"))
    result = lambda mode, text, conf, valid, rule: F.struct(F.lit(mode).alias("mode"), text.alias("text"), conf.alias("conf"), valid.alias("syntax_valid"), rule.alias("rule_valid"))
    fan = [result("raw_cnn", F.col("raw_text"), least_confidence(hyp), F.lit(True), F.lit(None).cast("boolean"))] if "raw_cnn" in modes else []
    if set(modes) & {"grammar_fsm", "tri_engine"}:
        ready = decode(ready, lexicon, registry_substitution=registry_substitution)
        fan += [result("grammar_fsm", F.col("text"), F.col("fsm_conf"), F.col("valid"), F.col("valid"))] if "grammar_fsm" in modes else []
    if "tri_engine" in modes:
        ready = verify(ready)
        fan.append(result("tri_engine", F.col("verified_text"), fused(F.col("fsm_conf"), F.col("sem_conf")), F.lit(True), F.col("valid")))
    one = F.explode(F.array(*fan)) if len(fan) > 1 else fan[0]
    rows = ready.select(*kept, "raw_text", "mean_conf", one.alias("r")).select(*kept, "raw_text", "mean_conf", "r.*", F.lit(None).cast("double").alias("latency_ms"))
    return gate(rows, theta)
