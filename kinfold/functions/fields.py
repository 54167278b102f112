"""Field types: by column name on the driver, by votes of the values in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column
import pyspark.sql.functions as F

#: Column names in order of precedence.
BY_NAME = {
    "name": "company_name display_name entity_name first_name full_name given_name last_name name product_name surname title",
    "email": "e_mail email mail",
    "url": "homepage link uri url website",
    "phone": "contact_number fax mobile phone tel",
    "address": "address city country location state street zip",
    "identifier": "asin ean id identifier isbn sku upc uuid",
    "date": "birth_date created date dob timestamp updated",
    "numeric": "amount count num price quantity revenue size",
}

_DIGITS = r"\p{Nd}"


def type_of_name(column: str) -> str | None:
    """The type that the column's name gives away."""
    key = column.lower().replace(" ", "_")
    return next((kind for kind, names in BY_NAME.items() if key in names.split()), None)


def votes(value: Column) -> dict[str, Column]:
    """Whether a value, without white space around it, looks like each type; in order of precedence."""
    v = F.trim(value)
    letters = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    return {
        "email": v.rlike(r"^[^@\s]+@[^@\s]+[.][^@\s]+$"),
        "url": v.rlike(r"(?i)^(https?://|www\.)"),
        "date": v.rlike(rf"^({_DIGITS}{{4}}-{_DIGITS}{{2}}-{_DIGITS}{{2}}|{_DIGITS}{{1,2}}/{_DIGITS}{{1,2}}/{_DIGITS}{{2,4}})"),
        "phone": (F.length(v) >= 7) & v.rlike(rf"^[{_DIGITS}\s().+-]+$"),
        "numeric": v.rlike(rf"^[{_DIGITS}.,-]+$"),
        "name": (F.length(v) < 100) & (letters >= F.length(v) * 0.5),
    }


def decide(column: str, total: int, counts: dict[str, int]) -> str:
    """The column's name decides first; then the first type with at least half the votes; else text."""
    named = type_of_name(column)
    if named or not total:
        return named or "text"
    return next((kind for kind, n in counts.items() if 2 * n >= total), "text")


