"""Evidence structs: a value together with how well the capture supports it.

A session carries thirteen of these.  Values are text (`true`, `false`, a version name, ...).
The frames behind a fact are summarised here as first, last and count, which keeps a session
row bounded; the full frame list is its own table (see `operators.sessions.evidence_frames`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepost.functions import vocab

EVIDENCE_TYPE = ("struct<value:string,state:string,basis:string,provenance:string,"
                 "frame_lo:bigint,frame_hi:bigint,frame_n:bigint>")


def build(value, state, basis, provenance="none", frames: tuple | None = None) -> Column:
    """An evidence struct from columns or literals; `frames` is (first, last, count)."""
    def col(x, kind):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    lo, hi, n = frames if frames is not None else (None, None, 0)
    return F.struct(
        col(value, "string").alias("value"), col(state, "string").alias("state"),
        col(basis, "string").alias("basis"), col(provenance, "string").alias("provenance"),
        col(lo, "bigint").alias("frame_lo"), col(hi, "bigint").alias("frame_hi"),
        F.coalesce(col(n, "bigint"), F.lit(0).cast("bigint")).alias("frame_n"))


def observed(value, basis, frames=None) -> Column:
    return build(value, "OBSERVED", basis, "observed", frames)


def inferred(value, basis, frames=None) -> Column:
    return build(value, "INFERRED", basis, "none", frames)


def ambiguous(value, basis, frames=None) -> Column:
    return build(value, "AMBIGUOUS", basis, "none", frames)


def unknown(basis) -> Column:
    return build(None, "UNKNOWN", basis)


def incomplete(basis) -> Column:
    return build(None, "INCOMPLETE", basis)


def not_observable(basis) -> Column:
    return build(None, "NOT_OBSERVABLE", basis)


def lean(sessions: DataFrame, *parts: str) -> DataFrame:
    """Sessions whose evidence fields are without these parts; the columns and their types stay."""
    def bare(field):
        kinds = {f.name: f.dataType for f in sessions.schema[field].dataType.fields}
        return reduce(lambda c, p: c.withField(p, F.lit(None).cast(kinds[p])), [p for p in parts if p in kinds], F.col(field))
    return sessions.withColumns({f: bare(f) for f in vocab.EVIDENCE_FIELDS if f in sessions.columns})


def value_or(field: str, default=None) -> Column:
    """The value, but only where it is conclusive."""
    return F.when(F.col(f"{field}.state").isin("OBSERVED", "INFERRED"), F.col(f"{field}.value")) \
        .otherwise(F.lit(default).cast("string"))


def reading(field: str) -> Column:
    """Value-first reading, the one baselines use."""
    return F.coalesce(F.col(f"{field}.value"), F.col(f"{field}.state"))


def tri_state(field: str) -> Column:
    """State-first reading, the one feature vectors use: undecided facts report their state."""
    return F.when(F.col(f"{field}.state").isin("OBSERVED", "INFERRED")
                  & F.col(f"{field}.value").isin("true", "false"), F.col(f"{field}.value")) \
        .otherwise(F.col(f"{field}.state"))


#: a bit for each kind of state that a finding consulted, and one for having consulted any
CONSULTED = {"OBSERVED": 1, "INFERRED": 2, "AMBIGUOUS": 4, "INCOMPLETE": 4, "NOT_OBSERVABLE": 8}
ANY = 16


def _bit(state: Column, place: int = 0) -> Column:
    """The bit of a state, moved to the four bits of a place.  A lookup names the state once; a ladder of
    comparisons would repeat it, and with it whatever it is worked out from."""
    table = F.create_map(*[F.lit(x) for name, bit in CONSULTED.items() for x in (name, bit << 4 * place)])
    return F.coalesce(F.element_at(table, state).cast("bigint"), F.lit(0).cast("bigint"))


def bits_of(refs: Column) -> Column:
    """The bits of a list of evidence pointers."""
    start = F.when(F.size(refs) > 0, ANY).otherwise(0).cast("bigint")
    found = F.aggregate(refs, start, lambda bits, r: bits.bitwiseOR(_bit(r["evidence_state"])))
    return F.coalesce(found, F.lit(0)).cast("int")


def packed_states(fields: list[str]) -> Column:
    """The states of up to fifteen fields of a session as one number, four bits each."""
    if len(fields) > 15:
        raise ValueError("a number has room for the states of fifteen fields")
    return reduce(lambda a, b: a + b, [_bit(F.col(f"{f}.state"), i) for i, f in enumerate(fields)])


def bits_of_packed(packed: Column, fields: list[str], wanted: list[list[str]], number: Column) -> Column:
    """The bits of the entry of `wanted`, a list of lists of fields, with this number."""
    masks = [sum(15 << 4 * fields.index(f) for f in set(one)) for one in wanted]
    mask = F.get(F.array(*[F.lit(m).cast("bigint") for m in masks]), number)
    seen = packed.bitwiseAND(mask)
    every = sum(1 << 4 * i for i in range(len(fields)))
    bits = F.when(mask != 0, ANY).otherwise(0)
    for bit in sorted(set(CONSULTED.values())):
        hit = seen.bitwiseAND(F.lit(bit * every).cast("bigint")) != 0
        bits = bits + F.when(hit, bit).otherwise(0)
    return bits


def _problem(field: str) -> Column:
    state, value, basis = (F.col(f"{field}.{p}") for p in ("state", "value", "basis"))
    return (F.when(F.col(field).isNull() | state.isNull()
                   | ~state.isin(vocab.EVIDENCE_STATES), "unknown evidence state")
            .when((state == "OBSERVED") & value.isNull(), "observed without a value")
            .when((state == "INFERRED") & (F.coalesce(basis, F.lit("")) == ""),
                  "inferred without a basis")
            .when(state.isin("UNKNOWN", "INCOMPLETE", "NOT_OBSERVABLE") & value.isNotNull(),
                  "value on a valueless state"))


def validate_evidence(sessions: DataFrame, fields=None) -> DataFrame:
    """Quarantine rows: one per session and field that breaks an evidence invariant."""
    fields = fields or [f for f in vocab.EVIDENCE_FIELDS if f in sessions.columns]
    checks = F.array(*[F.struct(F.lit(f).alias("field"), _problem(f).alias("problem"),
                                F.col(f"{f}.state").alias("state"),
                                F.col(f"{f}.value").alias("value")) for f in fields])
    return (sessions
            .select("capture_id", "tcp_stream_id",
                    F.explode(F.filter(checks, lambda c: c["problem"].isNotNull())).alias("c"))
            .select("capture_id", "tcp_stream_id", "c.*"))


def rank(col: Column, ordered: list[str]) -> Column:
    """Position of a label in a closed vocabulary, for max/min by meaning, not by spelling."""
    return reduce(lambda acc, pair: acc.when(col == pair[1], F.lit(pair[0])),
                  list(enumerate(ordered))[1:], F.when(col == ordered[0], F.lit(0)))


def unrank(col: Column, ordered: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ordered]), (col + 1).cast("int"))
