"""Clinical rules as CASE expressions: severities, patient flags, adjustments, urgency and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Report outcome codes with their labels and weights: fixed values.
OUTCOMES = {
    "DE": ("death", 5),
    "LT": ("life_threatening", 4),
    "HO": ("hospitalization", 3),
    "DS": ("disability", 3),
    "CA": ("congenital_anomaly", 3),
    "RI": ("required_intervention", 2),
    "OT": ("other", 1),
}
#: Words in a description and the severity they show: fixed values.
SEVERITY_WORDS = {"major": 3, "severe": 3, "serious": 3, "moderate": 2, "minor": 1, "mild": 1, "minimal": 1}
#: Years in one unit of a reported age: fixed values.
AGE_UNITS = {"YR": 1.0, "DEC": 10.0, "MON": 1 / 12, "WK": 1 / 52, "DY": 1 / 365, "HR": 1 / 8760}
#: Destinations of an alert by severity, and of a critical one: fixed values.
DESTINATIONS = {0: ("log",), 1: ("log", "patient"), 2: ("log", "patient", "pharmacist"), 3: ("log", "patient", "pharmacist", "physician", "ehr")}
CRITICAL = ("physician", "ehr", "pharmacist", "patient")


def _looked_up(key: Column, table: dict, default: object) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def outcome_label(code: Column) -> Column:
    return _looked_up(F.upper(F.trim(code)), {k: v[0] for k, v in OUTCOMES.items()}, "other")


def outcome_weight(code: Column) -> Column:
    return _looked_up(F.upper(F.trim(code)), {k: v[1] for k, v in OUTCOMES.items()}, 1)


def severity_of_text(text: Column) -> Column:
    """The greatest severity whose word occurs, even inside another word; 0 if none."""
    return F.greatest(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(s)).otherwise(F.lit(0)) for w, s in SEVERITY_WORDS.items()])


def age_years(age: Column, unit: Column) -> Column:
    """Age in years from text and unit code; null if no number or outside 0 to 120."""
    years = age.try_cast("double") * _looked_up(F.upper(F.trim(unit)), AGE_UNITS, 1.0)
    return F.when(years.between(0, 120), years)


def patient_flags(egfr: Column, ast: Column, alt: Column, age: Column, inr: Column) -> dict[str, Column]:
    """Impairments and risks by laboratory values; a missing value raises no flag."""
    flags = {
        "renal_impaired": egfr < 60,
        "renal_severe": egfr < 30,
        "hepatic_impaired": (ast > 120) | (alt > 120),
        "elderly": age >= 75,
        "bleeding_risk": inr > 3.0,
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def adjusted_severity(
    base: Column,
    *,
    renal_cleared: Column,
    hepatic_cleared: Column,
    anticoagulant: Column,
    pregnancy_risk: Column,
    renal_impaired: Column,
    renal_severe: Column,
    hepatic_impaired: Column,
    elderly: Column,
    pregnant: Column,
    dialysis: Column,
    high_inr: Column,
    prior_ignored: Column,
) -> tuple[Column, Column]:
    """(severity after all rules, at most 3; the rules that held, in order, as structs of ``rule`` and ``delta``).

    A rule either adds one or lifts what stands so far to three; the delta is
    what it adds. The rule of a high INR counts only where it lifts.
    """
    holds = {
        "renal_severe": (renal_cleared & renal_severe, True),
        "renal_moderate": (renal_cleared & renal_impaired & ~F.coalesce(renal_severe, F.lit(False)), False),
        "hepatic_impaired": (hepatic_cleared & hepatic_impaired, False),
        "elderly": (elderly, False),
        "high_inr_anticoagulant": (anticoagulant & high_inr, True),
        "pregnancy_contraindicated": (pregnancy_risk & pregnant, True),
        "dialysis": (renal_cleared & dialysis, True),
        "prior_ignored_alert": (prior_ignored, False),
    }
    flags = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(held, F.lit(False)).alias("held"), F.lit(lifts).alias("lifts"))
        for name, (held, lifts) in holds.items()
    ]
    none = F.array().cast("array<struct<rule:string,delta:int>>")

    def applied(state: Column, flag: Column) -> Column:
        delta = F.when(flag["lifts"], F.greatest(F.lit(0), 3 - state["severity"])).otherwise(1).cast("int")
        counts = flag["held"] & ((flag["rule"] != "high_inr_anticoagulant") | (delta > 0))
        rules = F.concat(state["rules"], F.array(F.struct(flag["rule"].alias("rule"), delta.alias("delta"))))
        return F.struct(
            F.when(counts, state["severity"] + delta).otherwise(state["severity"]).cast("int").alias("severity"),
            F.when(counts, rules).otherwise(state["rules"]).alias("rules"),
        )

    state = F.aggregate(F.array(*flags), F.struct(base.cast("int").alias("severity"), none.alias("rules")), applied)
    return F.least(F.lit(3), state["severity"]), state["rules"]


def urgency(severity: Column, *, inr: Column, anticoagulant: Column, pregnant: Column, pregnancy_risk: Column, dialysis: Column, prior_unacknowledged: Column) -> Column:
    """routine, priority, urgent or critical; an ignored earlier alert moves the first two up a step."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    critical = yes((inr > 3.5) & anticoagulant) | yes(pregnant & pregnancy_risk) | yes(dialysis & (severity >= 3))
    base = F.when(severity >= 3, "urgent").when(severity == 2, "priority").otherwise("routine")
    bumped = F.when(base == "routine", "priority").when(base == "priority", "urgent").otherwise(base)
    return F.when(critical, "critical").when(yes(prior_unacknowledged), bumped).otherwise(base)


def destinations(severity: Column, is_critical: Column) -> Column:
    """Where an alert goes, in order, each place once."""
    base = F.lit(None).cast("array<string>")
    for s, places in DESTINATIONS.items():
        base = F.when(severity == s, F.array(*map(F.lit, places))).otherwise(base)
    base = F.coalesce(base, F.array(F.lit("log")))
    return F.when(F.coalesce(is_critical, F.lit(False)), F.array_union(base, F.array(*map(F.lit, CRITICAL)))).otherwise(base)


def lab_flag(value: Column, low: Column, high: Column, critical_low: Column, critical_high: Column) -> Column:
    return F.when(value <= critical_low, "CRIT LOW").when(value >= critical_high, "CRIT HIGH").when(value < low, "LOW").when(value > high, "HIGH").when(value.isNotNull(), "normal")


#: Severity and confidence of known pairs, and of all others: fixed values.
KNOWN_PAIRS = {
    ("warfarin", "aspirin"): (3, 0.91),
    ("warfarin", "ibuprofen"): (3, 0.88),
    ("metformin", "contrast_dye"): (2, 0.85),
    ("simvastatin", "clarithromycin"): (3, 0.93),
    ("ssri", "tramadol"): (3, 0.87),
    ("lisinopril", "potassium"): (2, 0.82),
    ("metoprolol", "verapamil"): (2, 0.84),
    ("ciprofloxacin", "antacid"): (1, 0.79),
}
UNKNOWN_PAIR = (0, 0.35)
#: Names of the severities 0 to 3 in two vocabularies, where an alert of each goes, and the confidence under which more evidence is sought: fixed values.
SEVERITY_LABELS = ("none", "mild", "moderate", "severe")
MODEL_LABELS = ("none", "minor", "moderate", "major")
ALERT_TYPES = ("log_only", "patient", "pharmacist", "physician")
LOW_CONFIDENCE = 0.6


def known_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """(severity from 0 to 3, confidence) of an unordered pair of generic names."""
    key = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    table = {"|".join(sorted(pair)): values for pair, values in KNOWN_PAIRS.items()}
    severity, confidence = (_looked_up(key, {k: v[i] for k, v in table.items()}, UNKNOWN_PAIR[i]) for i in (0, 1))
    return F.least(F.lit(3), F.greatest(F.lit(0), severity)), confidence


def named(severity: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), severity)


def age_at(born: Column, day: Column) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(day, born) / 365).cast("int")
