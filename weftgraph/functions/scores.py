"""Scalar scores as column expressions: set overlaps, confidence, decay, states, vectors, fuzzy logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(x: Column, digits: int = 6) -> Column:
    """Rounded after a tiny allowance, so that sums taken in different orders agree where they fall halfway."""
    return F.round(x + 1e-9, digits)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two maps from keys to weights: sum of minima over sum of maxima, 0 if both are empty."""
    sides = lambda f: F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(sides(F.least), sides(F.greatest)), F.lit(0.0))


def role_weighted(role_similarity: Column, node_similarity: Column) -> Column:
    return 0.6 * role_similarity + 0.4 * node_similarity


def complementarity(a: Column, b: Column, evidence: Column) -> Column:
    """How much of the evidence two sets cover together, less what they share of it."""
    joint = F.size(F.array_intersect(F.array_union(a, b), evidence)) / F.size(evidence)
    return joint * (1 - jaccard(a, b, 0.0))


def decay_factor(batches: Column, members: Column) -> Column:
    return F.exp(-2.0 * batches / 50.0) * (1 + 0.2 * F.log1p(members))


def decayed(lifecycle: Column, confidence: Column, factor: Column) -> tuple[Column, Column]:
    """State and confidence after a batch: new and deprecated rows stay as they are; others go down a state below 0.40, and are deprecated below 0.1."""
    now = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence * factor))
    still = lifecycle.isin("New", "Deprecated")
    lower = F.when(lifecycle == "Stable", "Candidate").when(lifecycle == "Candidate", "Quarantine").otherwise(lifecycle)
    state = F.when(still, lifecycle).when(now < 0.1, "Deprecated").when(now < 0.4, lower).otherwise(lifecycle)
    return state, F.when(still, confidence).otherwise(now)


#: Type and provenance of a composition (None for any type), and the lifecycle and epistemic state that it starts with; the first that fits.
FIRST_STATES = (
    ("Event", "FrameCompiler", "New", "Observed"),
    ("Event", "ExtractionRepair", "Candidate", "Observed"),
    ("Event", "EnrichmentFeedback", "Candidate", "Observed"),
    ("HiddenMeaning", "HiddenMeaningRule", "Candidate", "Inferred"),
    ("HiddenMeaning", "EnrichmentFeedback", "Candidate", "Inferred"),
    ("Pattern", "PatternMining", "Candidate", "Inferred"),
    ("Hypothesis", "Abductive", "Quarantine", "Hypothesis"),
    ("Acquisition", "AcquisitionRecall", "Stable", "Grounded"),
    ("Acquisition", "AcquisitionSelfStudy", "Quarantine", "Inferred"),
    ("Acquisition", "AcquisitionUserAnswer", "Candidate", "Observed"),
    ("Acquisition", "HumanAssertion", "Stable", "Grounded"),
    (None, "HumanAssertion", "Candidate", "Grounded"),
)
OTHER_FIRST_STATES = ("New", "Observed")


def initial_states(comp_type: Column, provenance: Column) -> tuple[Column, Column]:
    def pick(k: int) -> Column:
        chosen = None
        for kind, source, *states in FIRST_STATES:
            fits = (provenance == source) if kind is None else (comp_type == kind) & (provenance == source)
            chosen = F.when(fits, states[k]) if chosen is None else chosen.when(fits, states[k])
        return chosen.otherwise(OTHER_FIRST_STATES[k])

    return pick(0), pick(1)


def promotable_to_stable(age: Column, confidence: Column, sound_members: Column, contradicted: Column, seed: Column) -> Column:
    return (age >= 3) & (confidence >= 0.55) & (sound_members >= 2) & ~contradicted & (seed >= 0.3)


def promotable_to_grounded(epistemic: Column, confidence: Column, contradicted: Column, seed: Column, sources: Column) -> Column:
    return (epistemic == "Inferred") & (confidence >= 0.7) & ~contradicted & (seed >= 0.5) & (sources > 1)


def frame_confidence(agent: Column, patient: Column, others: Column, negated: Column) -> Column:
    raw = 0.30 + F.when(agent, 0.15).otherwise(0.0) + F.when(patient, 0.15).otherwise(0.0) + 0.10 * others - F.when(negated, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def frame_quality(agent: Column, patient: Column, confidence: Column) -> Column:
    return F.when((confidence >= 0.70) & agent & patient, "High").when((confidence >= 0.45) & (agent | patient), "Moderate").when(confidence >= 0.3, "Low").otherwise("Failed")


#: Heads of sentences by lifecycle and epistemic state (None for any), the first that fits; stable, grounded ones above 0.8 have none.
QUALIFIERS = (
    ("Stable", "Grounded", "Tampaknya, "),
    ("Candidate", "Inferred", "Berdasarkan analisis, "),
    ("New", "Observed", "Berdasarkan observasi, "),
    (None, "Hypothesis", "Kemungkinan besar, "),
    (None, "Contradicted", "Meskipun ada kontradiksi, "),
    ("Quarantine", None, "Perlu ditinjau kembali, "),
    ("Deprecated", None, "Sebelumnya diyakini, "),
)
OTHER_QUALIFIER = "Kemungkinan, "


def qualified(sentence: Column, lifecycle: Column, epistemic: Column, confidence: Column) -> Column:
    """A sentence after the first head that fits its state."""
    fits = lambda state, kind: (True if state is None else lifecycle == state, True if kind is None else epistemic == kind)
    head = F.when((lifecycle == "Stable") & (epistemic == "Grounded") & (confidence > 0.8), "")
    for state, kind, text in QUALIFIERS:
        a, b = fits(state, kind)
        head = head.when(F.lit(True) & a & b, text)
    return F.concat(head.otherwise(OTHER_QUALIFIER), sentence)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or of length 0."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(0.0)


def fitted(a: Column, size: int) -> Column:
    """Cut or filled with zeros to a size, then of unit length."""
    cut = F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size)), 1, size)
    return F.transform(cut, lambda x: F.coalesce(F.try_divide(x, norm(cut)), F.lit(0.0)))


def tnorm(kind: str, a: Column, b: Column) -> Column:
    return {"product": lambda: a * b, "lukasiewicz": lambda: F.greatest(F.lit(0.0), a + b - 1), "godel": lambda: F.least(a, b)}[kind]()


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
