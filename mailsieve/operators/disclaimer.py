"""Legal disclaimers: by phrase, then by the position of a header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rx import Spans, before, collapse, java, let, remove_all, strip

#: Phrases, headers after which nothing counts, separators that stand before them.
PHRASES = (
    r"CONFIDENTIALITY NOTICE:?\s*\n.*?\n\s*\n",
    r"DISCLAIMER:?\s*\n.*?\n\s*\n",
    r"This\s+(?:e-?mail|message|communication|transmission)\s+(?:is\s+)?(?:intended\s+only\s+for|confidential|strictly\s+confidential).*?(?:\n\s*\n|\Z)",
    r"If\s+you\s+have\s+received\s+this\s+(?:e-?mail|message).*?(?:\n\s*\n|\Z)",
    r"The\s+information\s+contained\s+in\s+this\s+(?:e-?mail|message).*?(?:\n\s*\n|\Z)",
    r"This\s+(?:e-?mail|message)\s+and\s+any\s+attachments\s+are\s+confidential.*?(?:\n\s*\n|\Z)",
    r"Although\s+we\s+have\s+taken\s+reasonable\s+precautions.*?virus.*?(?:\n\s*\n|\Z)",
    r"No\s+liability\s+is\s+accepted\s+for\s+any\s+opinions.*?(?:\n\s*\n|\Z)",
    r"Please\s+consider\s+the\s+environment\s+before\s+printing.*?(?:\n|\Z)",
    r"(?:GDPR|EU General Data Protection Regulation).*?(?:\n\s*\n|\Z)",
    r"(?:data protection|personal data).*?(?:rights|regulation).*?(?:\n\s*\n|\Z)",
)
HEADER = r"(?:^|\n)\s*(?:CONFIDENTIALITY NOTICE|DISCLAIMER|LEGAL NOTICE|PRIVACY NOTICE|IMPORTANT NOTICE|CAUTION|WARNING|ATTENTION)\s*[:\n]"
SEPARATORS = (r"-{10,}", r"_{10,}", r"\*{10,}", r"={10,}")
LOOK_BACK = 100


#: The phrases whose gaps may have no end: those after which a blank line or a word must come.
SPANS = {
    PHRASES[0]: Spans(r"CONFIDENTIALITY NOTICE:?\s*\n", (r"\n\s*\n",)),
    PHRASES[1]: Spans(r"DISCLAIMER:?\s*\n", (r"\n\s*\n",)),
    PHRASES[6]: Spans(r"Although\s+we\s+have\s+taken\s+reasonable\s+precautions", (r"virus",), r"\n\s*\n"),
    PHRASES[10]: Spans(r"(?:data protection|personal data)", (r"(?:rights|regulation)",), r"\n\s*\n"),
}
#: What a text must hold for a phrase to match, by phrase.
PHRASE_WORDS = ("ty not", ("cla", "mer"), ("conf", "dent"), "ntended", ("rece", "ved", "you"), ("nformat", "conta", "ned"), "attachment", "precaut", "accepted", "ronment", "gdpr", "data protect", "onal data")


def by_phrase(text: Column) -> Column:
    return strip(collapse(remove_all(text, PHRASE_WORDS, [SPANS.get(p, p) for p in PHRASES])))


def by_position(text: Column) -> Column:
    """The text before the first header or, within 100 characters before it, the first kind of separator that occurs."""
    header = java(HEADER, "i")

    def cut(head: Column) -> Column:
        near = F.right(head, F.lit(LOOK_BACK))
        far = F.left(head, F.greatest(F.length(head) - LOOK_BACK, F.lit(0)))
        out = head
        for s in reversed(SEPARATORS):
            out = F.when(near.rlike(s), F.concat(far, before(near, s))).otherwise(out)
        return strip(out)

    return let(text, lambda t: F.when(t.rlike(header), let(before(t, header), cut)).otherwise(t))


def remove_disclaimer(text: Column) -> tuple[Column, Column]:
    out = by_position(by_phrase(text))
    return out, F.length(out) < F.length(text)
