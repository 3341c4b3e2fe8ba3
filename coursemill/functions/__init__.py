"""Column expressions: money rules, rating rounding, texts and times."""

from .money import coupon_discount, coupon_usable
from .rating import one_decimal
from .texts import WHITESPACE, code_label, contains_text, first_char, json_text, strip
from .times import day_ranges, iso_text, time_literal

__all__ = [
    "WHITESPACE",
    "code_label",
    "contains_text",
    "coupon_discount",
    "coupon_usable",
    "day_ranges",
    "first_char",
    "iso_text",
    "json_text",
    "one_decimal",
    "strip",
    "time_literal",
]
