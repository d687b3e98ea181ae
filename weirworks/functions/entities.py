"""Sensitive-data entities: names, patterns and detection."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The managed entity names.
MANAGED = (
    "PERSON_NAME", "EMAIL", "CREDIT_CARD", "IP_ADDRESS", "MAC_ADDRESS", "PHONE_NUMBER",
    "USA_PASSPORT_NUMBER", "USA_SSN", "USA_ITIN", "BANK_ACCOUNT", "USA_DRIVING_LICENSE", "USA_HCPCS_CODE", "USA_NATIONAL_DRUG_CODE",
    "USA_NATIONAL_PROVIDER_IDENTIFIER", "USA_DEA_NUMBER", "USA_HEALTH_INSURANCE_CLAIM_NUMBER", "USA_MEDICARE_BENEFICIARY_IDENTIFIER",
    "JAPAN_BANK_ACCOUNT", "JAPAN_DRIVING_LICENSE", "JAPAN_MY_NUMBER", "JAPAN_PASSPORT_NUMBER", "UK_BANK_ACCOUNT", "UK_BANK_SORT_CODE",
    "UK_DRIVING_LICENSE", "UK_NATIONAL_HEALTH_SERVICE_NUMBER", "UK_NATIONAL_INSURANCE_NUMBER", "UK_PASSPORT_NUMBER", "UK_PHONE_NUMBER",
    "UK_UNIQUE_TAXPAYER_REFERENCE_NUMBER", "UK_VALUE_ADDED_TAX", "CANADA_SIN", "CANADA_PASSPORT_NUMBER", "GERMANY_PASSPORT_NUMBER",
    "GERMANY_DRIVING_LICENSE", "FRANCE_PASSPORT_NUMBER", "FRANCE_DRIVING_LICENSE", "SPAIN_NIF_NIE", "ITALY_DRIVING_LICENSE",
)

# Patterns for the managed entities with a publicly documented form. They mean the same to Java and to RE2: no
# look-around and no back-references.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "CREDIT_CARD": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "MAC_ADDRESS": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "PHONE_NUMBER": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b",
    "USA_SSN": r"\b[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}\b",
    "USA_ITIN": r"\b9[0-9]{2}-(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])-[0-9]{4}\b",
    "USA_DEA_NUMBER": r"\b[ABFGMPRabfgmpr][A-Za-z9][0-9]{7}\b",
    "USA_HCPCS_CODE": r"\b[A-V][0-9]{4}\b",
    "USA_NATIONAL_DRUG_CODE": r"\b[0-9]{4,5}-[0-9]{3,4}-[0-9]{1,2}\b",
    "USA_MEDICARE_BENEFICIARY_IDENTIFIER": r"\b[1-9][AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y][0-9]-?[AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y][0-9]-?[AC-HJKMNP-RT-Y]{2}[0-9]{2}\b",
    "UK_NATIONAL_INSURANCE_NUMBER": r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b",
    "UK_BANK_SORT_CODE": r"\b[0-9]{2}-[0-9]{2}-[0-9]{2}\b",
    "UK_NATIONAL_HEALTH_SERVICE_NUMBER": r"\b[0-9]{3} [0-9]{3} [0-9]{4}\b",
    "UK_VALUE_ADDED_TAX": r"\bGB ?(?:[0-9]{9}(?:[0-9]{3})?|(?:GD|HA)[0-9]{3})\b",
    "UK_PHONE_NUMBER": r"(?:\+44 ?|\b0)[1-9][0-9]{1,4} ?[0-9]{3,4} ?[0-9]{3,4}\b",
    "CANADA_SIN": r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{3}\b",
    "SPAIN_NIF_NIE": r"\b(?:[0-9]{8}|[XYZ][0-9]{7})-?[TRWAGMYFPDXBNJZSQVHLCKE]\b",
}

# What every match of a pattern contains; where nothing is listed, a digit.
MARKERS = {"EMAIL": "@", "MAC_ADDRESS": "[:-]"}

# Words one of which has to occur in the text when detection is set to LOW, as whole words in any case.
CONTEXT = {
    "EMAIL": ("mail", "e-mail", "email", "contact"),
    "CREDIT_CARD": ("card", "visa", "credit", "payment"),
    "IP_ADDRESS": ("ip", "host", "server", "address"),
    "MAC_ADDRESS": ("mac", "ethernet", "device", "address"),
    "PHONE_NUMBER": ("phone", "tel", "call", "fax"),
    "USA_SSN": ("ssn", "social security"),
    "USA_ITIN": ("itin", "taxpayer", "tax"),
    "USA_DEA_NUMBER": ("dea", "prescriber"),
    "USA_HCPCS_CODE": ("hcpcs", "procedure"),
    "USA_NATIONAL_DRUG_CODE": ("ndc", "drug"),
    "USA_MEDICARE_BENEFICIARY_IDENTIFIER": ("mbi", "medicare", "beneficiary"),
    "UK_NATIONAL_INSURANCE_NUMBER": ("nino", "national insurance"),
    "UK_BANK_SORT_CODE": ("sort code", "bank"),
    "UK_NATIONAL_HEALTH_SERVICE_NUMBER": ("nhs", "health"),
    "UK_VALUE_ADDED_TAX": ("vat", "value added tax"),
    "UK_PHONE_NUMBER": ("phone", "tel", "call", "mobile"),
    "CANADA_SIN": ("sin", "social insurance"),
    "SPAIN_NIF_NIE": ("nif", "nie", "dni"),
}


@dataclass(frozen=True)
class Entity:
    """A pattern with optional context words: with words, a match counts only when one occurs in the text."""

    name: str
    pattern: str
    context: tuple[str, ...] = ()
    # A cheap pattern every match contains; texts without it need no search.
    marker: str = ""


def managed(name: str, sensitivity: str = "HIGH") -> Entity:
    """A managed entity. LOW detection also asks for one of its context words, and cannot be had for an entity without any."""
    if name not in MANAGED:
        raise ValueError(f"unknown entity {name!r}")
    if name not in PATTERNS:
        raise ValueError(f"{name} has no public pattern: it needs a custom pattern")
    if sensitivity not in ("HIGH", "LOW"):
        raise ValueError("sensitivity is HIGH or LOW")
    if sensitivity == "LOW" and not CONTEXT.get(name):
        raise ValueError(f"{name} has no context words for LOW detection: give it some as a custom entity")
    return Entity(name, PATTERNS[name], CONTEXT.get(name, ()) if sensitivity == "LOW" else (), MARKERS.get(name, "[0-9]"))


def custom(name: str, pattern: str, context: Sequence[str] = ()) -> Entity:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,255}", name or ""):
        raise ValueError("an entity name has 1 to 255 letters, digits, dashes or underscores")
    if not pattern or not pattern.strip():
        raise ValueError("the pattern is empty")
    return Entity(name, pattern, tuple(context))


def validate(df: DataFrame, column: str, entity: Entity, keep: int = 20) -> DataFrame:
    """The first ``keep`` matches in every text. A pattern Spark cannot compile raises here."""
    _compiles(df, entity.pattern)
    return df.withColumn("matches", F.slice(matches(F.col(column), entity), 1, keep))


def _compiles(df: DataFrame, pattern: str) -> None:
    try:
        df.sparkSession.range(1).select(F.regexp_count(F.lit(""), F.lit(pattern))).collect()
    except Exception as bad:
        raise ValueError(f"the pattern does not compile: {pattern}") from bad


def has_context(text: Column, entity: Entity) -> Column:
    return text.rlike(context_pattern(entity.context)) if entity.context else F.lit(True)


def context_pattern(words: Sequence[str]) -> str:
    """The words in any case, whole: where a word begins or ends with a letter or digit, no other may touch it."""

    def whole(word: str) -> str:
        return (r"\b" if word[0].isalnum() else "") + re.escape(word) + (r"\b" if word[-1].isalnum() else "")

    return "(?i)" + "|".join(whole(w) for w in words)


def possible(text: Column, entity: Entity) -> Column:
    """A quick test that only texts with a match, and some others, pass."""
    return text.rlike(entity.marker) if entity.marker else F.lit(True)


def matches(text: Column, entity: Entity, likely: Column | None = None) -> Column:
    """All matches in order. ``likely`` is ``possible`` worked out before, to share it among entities."""
    test = (possible(text, entity) if likely is None else likely) & has_context(text, entity)
    found = F.regexp_extract_all(text, F.lit(entity.pattern), F.lit(0))
    return F.when(test, found).otherwise(F.array().cast("array<string>"))


def occurs(text: Column, entity: Entity, likely: Column | None = None) -> Column:
    test = possible(text, entity) if likely is None else likely
    return test & has_context(text, entity) & F.regexp_like(text, F.lit(entity.pattern))


def count(text: Column, entity: Entity) -> Column:
    test = possible(text, entity) & has_context(text, entity)
    return F.when(test, F.regexp_count(text, F.lit(entity.pattern))).otherwise(0)


def rewrite(text: Column, entity: Entity, change) -> Column:
    """The text with every match replaced by ``change(match)``, a Column function."""
    between = F.split(text, entity.pattern, -1)
    changed = F.transform(F.regexp_extract_all(text, F.lit(entity.pattern), F.lit(0)), change)
    # There is one piece more than there are matches; the padding keeps both lists the same length.
    woven = F.zip_with(between, changed, lambda piece, new: F.concat(piece, F.coalesce(new, F.lit(""))))
    return F.when(occurs(text, entity), F.array_join(woven, "")).otherwise(text)


def masked(text: Column, entity: Entity, mask: str = "*******") -> Column:
    test = possible(text, entity) & has_context(text, entity)
    return F.when(test, F.regexp_replace(text, entity.pattern, mask)).otherwise(text)


def partly_masked(text: Column, entity: Entity, keep: int = 4) -> Column:
    """Each match with all but its last characters starred."""
    return rewrite(text, entity, lambda m: F.concat(F.repeat(F.lit("*"), F.greatest(F.length(m) - keep, F.lit(0))), F.right(m, F.lit(keep))))


def hashed(text: Column, entity: Entity) -> Column:
    """Each match replaced by its SHA-256."""
    return rewrite(text, entity, lambda m: F.sha2(m, 256))
