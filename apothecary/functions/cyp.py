"""Mentions of CYP enzymes in text, the roles that the words around them give, and figures of a pair's enzyme sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of enzymes, and words that show a role, tried in this order: fixed values.
ENZYME_PATTERN = r"(?i)CYP\s?(?:3A[45]|2D6|2C(?:8|9|19)|1A2|2B6|2E1)"
ROLE_PATTERNS = {
    "inhibitor": r"(?i)\b(inhibit(?:or|s|ing|ion)?)\b",
    "inducer": r"(?i)\b(induc(?:er|es|ing|tion)?)\b",
    "substrate": r"(?i)\b(substrate|metaboli[sz]ed\s+by|metaboli[sz]ed\s+via)\b",
}
#: How grave an interaction through an enzyme is: fixed values.
RISK = {"CYP3A4": 3, "CYP2D6": 3, "CYP2C9": 2, "CYP2C19": 2, "CYP1A2": 1, "CYP2B6": 1, "CYP2C8": 1, "CYP3A5": 1, "CYP2E1": 1}
#: Enzymes that a pair has a figure of its own for: fixed values.
FLAGGED = ("CYP3A4", "CYP2D6", "CYP2C9", "CYP2C19", "CYP1A2", "CYP2B6")
#: Letters on each side of a mention in which a role is looked for, and letters of a snippet: fixed values.
WINDOW, SNIPPET = 120, 200
ROLES = ("substrate", "inhibitor", "inducer")


def mentions(text: Column) -> Column:
    """Array of enzyme, role and snippet for each mention that has a role in its window, in order of the text."""

    def read(bound: Column) -> Column:
        names, gaps, whole = bound["names"], bound["gaps"], bound["whole"]
        total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

        def one(name: Column, k: Column) -> Column:
            start = total(F.slice(gaps, 1, k + 1)) + total(F.slice(names, 1, k))
            low = F.greatest(F.lit(0), start - WINDOW)
            window = F.substring(whole, low + 1, start + F.length(name) + WINDOW - low)
            role = F.coalesce(*[F.when(window.rlike(pattern), role) for role, pattern in ROLE_PATTERNS.items()])
            snippet = F.left(F.regexp_replace(window, r"^\s+|\s+$", ""), F.lit(SNIPPET))
            return F.struct(F.upper(F.regexp_replace(name, r"\s", "")).alias("enzyme"), role.alias("role"), snippet.alias("snippet"))

        return F.filter(F.transform(names, one), lambda m: m["role"].isNotNull())

    found = F.struct(F.regexp_extract_all(text, F.lit(f"({ENZYME_PATTERN})"), F.lit(1)).alias("names"), F.split(text, ENZYME_PATTERN, -1).alias("gaps"), text.alias("whole"))
    return F.get(F.transform(F.array(found), read), F.lit(0))


def nearer(text: Column, enzyme: Column, a: Column, b: Column) -> Column:
    """Which of two names stands nearer to the enzyme's first mention; null if that is written otherwise.

    A name that is not in the text is 9999 letters away; ties go to the first.
    """
    place = lambda x: F.instr(F.lower(text), F.lower(x))
    away = lambda x: F.when(place(x) > 0, F.abs(place(x) - place(enzyme))).otherwise(9999)
    return F.when(place(enzyme) > 0, F.when(away(a) <= away(b), a).otherwise(b))


def pair_figures(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Figures of two drugs' enzyme arrays by role (see ``ROLES``); null arrays count as empty."""
    empty = F.array().cast("array<string>")
    a, b = ({r: F.coalesce(side[r], empty) for r in ROLES} for side in (a, b))
    everything = empty
    for side in (a, b):
        for role in ROLES:
            everything = F.array_union(everything, side[role])
    risks = F.create_map(*[F.lit(x) for item in RISK.items() for x in item])
    crossed = lambda role: F.size(F.array_union(F.array_intersect(a[role], b["substrate"]), F.array_intersect(b[role], a["substrate"])))
    return {
        "shared_cyp_count": F.size(F.array_intersect(a["substrate"], b["substrate"])),
        "inhibitor_substrate_pairs": crossed("inhibitor"),
        "inducer_substrate_pairs": crossed("inducer"),
        **{f"{e.lower()}_involved": F.array_contains(everything, e).cast("int") for e in FLAGGED},
        "max_cyp_risk_score": F.coalesce(F.array_max(F.transform(everything, lambda e: F.coalesce(F.element_at(risks, e), F.lit(0)))), F.lit(0)),
        "any_cyp_interaction": (F.size(everything) > 0).cast("int"),
        "n_enzymes_involved": F.size(everything),
    }
