"""Telling what looks like a secret in messages and documents, by rules rather than by a list of token formats.

A value is one if the key before it names a secret, or if it is opaque: long, of letters and digits mixed, with as many
different characters as random text has.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log2

# What the name of a secret's key ends with, in lower case without punctuation.
KEY_ENDINGS = ("password", "passwd", "pwd", "secret", "token", "signature", "sig", "accesskey", "accountkey", "apikey", "privatekey", "credential", "credentials")
#: Domains that are set aside for documentation (RFC 2606).
DOCUMENTATION = ("example", "test", "invalid", "localhost")
#: Characters, and bits of entropy for each of them, from which a mixed word is opaque.
LONG, BITS = 24, 3.0
#: Words of documents and addresses: what is between white space, quotes and separators of keys and values.
_WORD = re.compile(r"[^\s;&,?'\"<>(){}\[\]]+")


def names_secret(key: str) -> bool:
    return re.sub(r"[^a-z]", "", key.lower()).endswith(KEY_ENDINGS)


def opaque(word: str) -> bool:
    """Whether a word could only be random: paths and dotted names are looked at part by part."""
    for part in re.split(r"[/\\:=.]", word):
        if len(part) >= LONG and re.search(r"\d", part) and re.search(r"[A-Za-z]", part) and not re.fullmatch(r"[A-Za-z]+(?:[-_][A-Za-z]+)*\d{0,8}", part):
            n = Counter(part)
            if sum(-k / len(part) * log2(k / len(part)) for k in n.values()) >= BITS:
                return True
    return False


def redacted(text: str) -> str:
    """``text`` with REDACTED for values of keys that name a secret, and for opaque words."""

    def put(found: re.Match) -> str:
        word = found[0]
        key, equals, value = word.partition("=")
        if equals and value and names_secret(key):
            return f"{key}=REDACTED"
        return f"{key}=REDACTED" if equals and opaque(value) else "REDACTED" if opaque(word) else word

    return _WORD.sub(put, text)


def exposed(text: str) -> bool:
    """Whether a document gives a secret outright, or the address of a person.

    A value that is a reference in double braces gives nothing away, nor does an address of a domain for documentation.
    """
    for key, value in re.findall(r"([\w.-]+)[\"']?\s*[:=]\s*[\"']([^\"']+)[\"']", text):
        if names_secret(key) and not value.startswith("{{"):
            return True
    words = _WORD.findall(text)
    return any(map(opaque, words)) or any(is_address(w) for w in words)


def is_address(word: str) -> bool:
    """A name, an at sign and a domain of at least two labels, none of the last two set aside for documentation."""
    name, at, domain = word.strip(":").partition("@")
    labels = domain.rstrip(".").lower().split(".")
    return bool(at and re.fullmatch(r"[\w.+-]+", name) and len(labels) > 1 and all(re.fullmatch(r"[a-z\d-]+", x) for x in labels) and not {*labels[-2:]} & {*DOCUMENTATION})
