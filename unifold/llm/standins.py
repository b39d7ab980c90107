"""Values that merely stand in for a missing one ("n/a", "<full_name>", "Candidate 17")."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from unifold.functions.text import squeeze

# Words and phrases that say a value is missing, compared in lower case without
# outer punctuation.
_PHRASES = (
    "", "n/a", "n.a", "na", "n a", "n.n", "nn", "n. n", "nil", "nan", "none", "null", "nul", "undefined", "unknown", "unnamed",
    "unbekannt", "inconnu", "desconocido", "anonymous", "anon", "anonym", "tbd", "tba", "tbc", "tbd.", "to be added",
    "to be announced", "to be confirmed", "to be determined", "to be defined", "to follow", "empty", "blank", "missing",
    "redacted", "withheld", "confidential", "hidden", "removed", "deleted", "private", "pending", "name pending",
    "not available", "not provided", "not given", "not known", "not specified", "not stated", "not set", "not entered",
    "not applicable", "unspecified", "unavailable", "nothing yet", "nothing", "no data", "no value", "no entry", "no info",
    "see attachment", "see attached", "see cv", "see resume", "see profile", "see notes", "see above", "see below",
    "see linkedin", "keine angabe", "k.a", "k. a", "ohne angabe", "ohne name", "non renseigné", "sin datos", "sin nombre",
    "sans nom", "s/n", "x", "xx", "xxx", "xxxx", "xxxxx", "test", "test test", "tester", "testing", "dummy", "sample",
    "example", "placeholder", "default", "lorem ipsum", "foo", "bar", "foo bar", "asdf", "qwerty", "todo", "fixme",
    "call later", "ask agency", "no answer", "coming soon", "work in progress", "wip", "?", "-", "first last",
    "firstname lastname", "first name last name", "vorname nachname", "john doe", "jane doe", "max mustermann",
    "erika mustermann", "candidate", "applicant", "employee", "person", "somebody", "someone", "user", "new user",
    "candidate name", "applicant name", "your name", "your name here", "insert name", "enter name", "name goes here",
    "full name", "full_name", "fullname", "name", "no name", "noname", "headline", "no headline", "headline goes here",
    "your headline", "your headline here", "insert headline", "enter headline", "add headline", "headline missing",
    "no headline provided", "headline pending", "title goes here", "profile headline", "no title", "title",
)
_NUMBERED = r"(candidate|applicant|employee|person|user|contact|record|profile|name|test|anonymous|unknown)\s*(no\.?|nr\.?|number|#|-|_)?\s*#?\s*\d+"
_TEMPLATE = r"(<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|\$\{.*\}|%[a-z_]+%)"


def is_stand_in(value: Column) -> Column:
    """True for null, blank and stand-in values: no letter or digit, a template, or a known phrase."""
    v = F.lower(squeeze(F.regexp_replace(F.coalesce(value, F.lit("")), "[ ​﻿]", " ")))
    core = F.regexp_replace(v, r"(?U)^[^\p{L}\p{N}?]+|[^\p{L}\p{N}?]+$", "")
    return (
        ~F.rlike(v, F.lit(r"[\p{L}\p{N}]"))
        | F.rlike(v, F.lit(f"^{_TEMPLATE}$"))
        | core.isin([p for p in _PHRASES])
        | v.isin([p for p in _PHRASES])
        | F.rlike(core, F.lit(f"^{_NUMBERED}$"))
    )


def stand_in(value: str | None) -> bool:
    """The same rule for one Python value."""
    v = re.sub(r"\s+", " ", re.sub("[ ​﻿]", " ", value or "")).strip().lower()
    core = re.sub(r"^[^\w?]+|[^\w?]+$", "", v.replace("_", " ") if v.startswith(("<", "[")) else v)
    return (
        not re.search(r"[^\W_]", v)
        or re.fullmatch(_TEMPLATE, v) is not None
        or core in _PHRASES
        or v in _PHRASES
        or re.fullmatch(_NUMBERED, core) is not None
    )
