"""Personal data, secrets and prompt-injection phrases as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and pattern, applied in this order to text already rewritten by the ones
# before. A match of an earlier label hides its characters from the later ones.
PII_PATTERNS: list[tuple[str, str]] = [
    ("EMAIL", r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]*[a-zA-Z0-9-]\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
    ("PHONE", r"\b(?:\+?\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("AWS_KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("JWT", r"\beyJ[a-zA-Z0-9_\-]*\.[a-zA-Z0-9_\-]*\.[a-zA-Z0-9_\-]*\b"),
    ("BEARER", r"\bBearer\s+[a-zA-Z0-9_\-\.]{20,}\b"),
]

# Phrases that mark an attempt to override instructions, case-insensitive, anywhere
# in the text; the first one in this order is reported.
INJECTION_PATTERNS: list[str] = [
    r"ignore\s+(all\s+)?(previous|prior)\s+instructions",
    r"override\s+(the\s+)?system\s+prompt",
    r"you\s+are\s+now\s+in\s+developer\s+mode",
    r"jailbreak\s+mode",
    r"act\s+as\s+DAN",
]

# A prompt with one of these substrings (in lower case) counts as complex.
COMPLEX_WORDS: list[str] = [
    "solve", "code", "optimize", "analyze", "debug", "proof", "explain", "why", "how to",
    "write a", "implement",
]
COMPLEX_LENGTH = 120

# What a text must contain for a pattern to have any chance; spares the costly patterns on
# ordinary prose. Labels and phrases without an entry are always tried.
_NEEDS = {
    "EMAIL": lambda t: t.contains("@"),
    "CREDIT_CARD": lambda t: t.rlike(r"(?:\p{Nd}[ -]*+){13}"),
    "PHONE": lambda t: t.rlike(r"\p{Nd}{3}[- ]?\p{Nd}{4}"),
    "SSN": lambda t: t.rlike(r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}"),
    "AWS_KEY": lambda t: t.contains("AKIA") | t.contains("ASIA"),
    "JWT": lambda t: t.contains("eyJ"),
    "BEARER": lambda t: t.contains("Bearer"),
}
# Parts of each phrase in lower case; without i, k and s, which have look-alikes in Unicode that
# match when case is ignored but do not become the plain letter in lower case.
_PHRASE_PARTS = dict(zip(INJECTION_PATTERNS, ["nore", "prompt", "developer", "mode", "dan"]))


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Classes such as ``\\b``, ``\\s`` and ``\\d`` cover Unicode."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def redacted(text: Column, patterns: Sequence[tuple[str, str]] = PII_PATTERNS) -> Column:
    """Replace every match by ``[LABEL_REDACTED]``; null and empty text stay as they are."""
    for label, pattern in patterns:
        text = _redact_label(text, label, pattern)
    return text


def _redact_label(text: Column, label: str, pattern: str) -> Column:
    def rewrite(t: Column) -> Column:
        done = F.regexp_replace(t, java_regex(pattern), f"[{label}_REDACTED]")
        return F.when(text_may_match(label, t), done).otherwise(t)

    # the text of the step before is used more than once, so it is given a name
    return F.get(F.transform(F.array(text), rewrite), 0)


def text_may_match(label: str, text: Column) -> Column:
    needs = _NEEDS.get(label)
    return F.lit(True) if needs is None else needs(text)


def first_injection(text: Column, patterns: Sequence[str] = INJECTION_PATTERNS) -> Column:
    """Position in the list of the first phrase found, or null."""
    found = None
    for i, pattern in enumerate(patterns):
        hit = text.rlike(java_regex(pattern, ignore_case=True))
        if pattern in _PHRASE_PARTS:
            hit = F.lower(text).contains(_PHRASE_PARTS[pattern]) & hit
        found = F.when(hit, i) if found is None else found.when(hit, i)
    return found


def is_complex(prompt: Column, words: Sequence[str] = COMPLEX_WORDS,
               max_length: int = COMPLEX_LENGTH) -> Column:
    low = F.lower(prompt)
    hit = F.length(low) > max_length
    for word in words:
        hit = hit | low.contains(word)
    return F.coalesce(hit, F.lit(False))


# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    """Trim Unicode white space on both sides (plain ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))
