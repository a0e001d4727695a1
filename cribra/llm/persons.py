"""Persons in author fields."""

from __future__ import annotations

import re
import unicodedata

#: What marks a desk, an agency or a placeholder. Fixed words, folded.
DESK_WORDS = frozenset("redaccion editorial editor editora admin administrador agencia agencias equipo unidad colaborador colaboradora colaboradores colaboracion mesa staff newsroom noticias anonimo anonima desconocido corresponsales servicios servicio prensa oficina comunicaciones web digital autor autora varios usuario invitado invitada investigacion datos linea red".split())
_ROLE = re.compile(r"^(?:columnista|periodista|corresponsal|enviad[oa](?: especial)?|editor[a]?|reporter[oa]|redactor[a]?|fotograf[oa]|analista|opinion|especial|colaborador[a]?|jefe de redaccion|director[a]?|cronista|texto|fotos?)\b")
_BY = re.compile(r"^(?:por|by|texto(?:s)? de|texto|escrito por|autor[a]?|de)\s*:?\s+", re.I)
_TITLE = re.compile(r"^(?:dr|dra|lic|ing|prof|sr|sra|srta|don|dona)\.?\s+")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s).casefold()
    return "".join(c for c in s if not unicodedata.combining(c))


def _letters(s: str) -> str:
    return "".join(c for c in s if c.isalpha())


def _within(key: str, s: str) -> bool:
    """key's letters stand in s in this order."""
    it = iter(s)
    return all(c in it for c in key)


def is_outlet(folded: str, outlets: tuple[str, ...]) -> bool:
    """A name that begins with an article, or holds an outlet's key: as its beginning, or letter by letter if long."""
    x = _letters(folded)
    if folded.startswith(("el ", "la ", "los ", "las ")):
        return True
    return any(x.startswith(k) or k.startswith(x) and len(x) >= 6 or len(k) >= 9 and len(x) >= len(k) and _within(k, x) for k in outlets if len(k) >= 5)


def persons(author: str | None, outlets: tuple[str, ...] = ()) -> list[str]:
    """Keys of the persons that one author element names: full names, folded, given name first.

    ``Surname, Name`` is turned round when either side of the only comma is a single word; otherwise a comma parts two
    persons. Roles in brackets, after a bar, a dash or a comma are left out. A single word is no full name; desks,
    agencies, outlets and placeholders give none; nor do null and blank.
    """
    if not author:
        return []
    s = fold(" ".join(author.replace("​", "").split()))
    s = re.sub(r"[(\[][^)\]]*[)\]]", " ", s)
    s = re.sub(r"\S+@\S+|https?://\S+|@\w+", " ", s)
    s = _BY.sub("", s.strip())
    whole = " ".join(s.split())
    if not whole or is_outlet(whole, outlets):
        return []
    out = []
    for part in re.split(r"\s*[;/&+]\s*|\s+(?:y|e|and|con)\s+", whole):
        part = re.split(r"\s*\|\s*|\s+[-–—]\s+", part)[0]
        bits = [b for b in (x.strip(" .,-") for x in part.split(",")) if b and not _ROLE.match(b)]
        if len(bits) == 2 and (" " not in bits[0] or " " not in bits[1]):
            bits = [f"{bits[1]} {bits[0]}"]
        for b in bits:
            b = _TITLE.sub("", _BY.sub("", b))
            words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", b)]
            if len(words) < 2 or len(words) > 6 or any(w in DESK_WORDS for w in words) or is_outlet(" ".join(words), outlets):
                continue
            out.append(" ".join(words))
    return list(dict.fromkeys(out))
