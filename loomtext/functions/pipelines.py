"""Text pipelines: named Column steps applied in order, with one that can end the rest.

A step is a function from Column to Column. ``Truncate`` cuts to a byte budget; a row that it cuts skips all later steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import strings, unicode
from loomtext.functions.grams import bound

Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Truncate:
    most: int

    def __call__(self, c: Column) -> Column:
        return strings.take_bytes(c, self.most)


@dataclass(frozen=True)
class TextPipeline:
    steps: tuple[Step, ...] = ()

    def then(self, step: Step) -> TextPipeline:
        return TextPipeline((*self.steps, step))

    def apply(self, c: Column) -> Column:
        """Everything after a ``Truncate`` happens only in rows that it left whole."""
        for k, step in enumerate(self.steps):
            if isinstance(step, Truncate):
                rest = TextPipeline(self.steps[k + 1 :])
                gated = lambda x: F.when(F.octet_length(x) > step.most, step(x)).otherwise(rest.apply(x))  # noqa: B023, E731
                return bound(c, gated) if _in_jvm(rest) else gated(c)
            c = step(c)
        return c

    def apply_into(self, prefix: Column, c: Column) -> Column:
        """Behind a text that is there already."""
        return F.concat(prefix, self.apply(c))


def _in_jvm(pipeline: TextPipeline) -> bool:
    """Whether all steps are plain expressions, which may stand inside a lambda; functions that run in Python may not."""
    return all(getattr(s, "__module__", "") == strings.__name__ or isinstance(s, Truncate) for s in pipeline.steps)


#: Steps of a preprocessing pipeline by name.
PREPROCESSING = {
    "nfc": unicode.nfc, "nfd": unicode.nfd, "nfkc": unicode.nfkc, "nfkd": unicode.nfkd, "case_fold": unicode.case_fold, "simple_case_fold": unicode.simple_case_fold,
    "strip_diacritics": unicode.strip_diacritics, "collapse_whitespace": strings.collapse_whitespace, "strip_controls": strings.strip_controls, "canonicalize_punctuation": strings.canonicalize_punctuation,
    "trim": strings.trim, "lowercase": strings.to_lowercase, "display_safe": unicode.display_safe, "search_key": unicode.search_key, "identifier": unicode.identifier,
}


@dataclass(frozen=True)
class PreprocessingPipeline:
    """Steps by name, which also make its label."""

    names: tuple[str, ...]

    def __post_init__(self) -> None:
        if unknown := [n for n in self.names if n not in PREPROCESSING]:
            raise ValueError(f"unknown steps {unknown}")

    @property
    def label(self) -> str:
        return "+".join(self.names)

    def apply(self, c: Column) -> Column:
        for name in self.names:
            c = PREPROCESSING[name](c)
        return c
