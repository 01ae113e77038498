"""Ordered keyword classification (first matching category wins), as SQL text."""

from ..rules import RuleSet
from .text import bind, contains_any, lit


def classify(text: str, rules: RuleSet) -> str:
    """Category of a description: one CASE over the lower-case text, in rule order."""
    cases = " ".join(
        f"WHEN {contains_any('words_', words)} THEN {lit(category)}" for category, words in rules.categories
    )
    return bind(f"lower({text})", "words_", f"CASE {cases} ELSE {lit(rules.default)} END")


def category_rank(category: str, rules: RuleSet) -> str:
    """Position of a category in its rule set."""
    names = ", ".join(lit(name) for name in rules.names())
    return f"CAST(array_position(array({names}), {category}) AS int) - 1"
