"""Labelled documents from which the rule list of quality.py is induced. Invented text; label 1 is no running prose."""

from __future__ import annotations

import base64
import random
import string
import unicodedata

_WHO = ["la rectora", "el alcalde de Ibara", "una vecina", "el comité", "la ministra Lena Ardila", "el juez", "un grupo de pescadores", "la oficina de aguas", "Marta Osuna", "el sindicato"]
_DID = ["presentó", "rechazó", "aplazó", "defendió ante la prensa", "volvió a pedir", "leyó en voz alta", "criticó", "aprobó", "discutió durante horas", "retiró"]
_WHAT = ["el plan de riego", "la reforma del puerto", "un informe sobre las escuelas", "la venta del mercado", "el cierre de la vía", "las cuentas del año", "la nueva ley de semillas", "el contrato de la basura"]
_WHEN = ["el martes", "después de la reunión", "antes de que llegara el invierno", "en la sesión del 14 de mayo", "con 23 votos a favor", "sin dar más detalles", "a las 7 de la noche", "porque faltaban 3.200 millones"]
_AND = ["y dijo que no habrá otra oportunidad", "aunque nadie lo esperaba", "mientras los vecinos seguían en la calle", "para que se cumpla lo que dice el acuerdo", "pero la decisión todavía no está en firme", "que se había anunciado desde enero"]
_EXTRA = ["Ardila Osuna", "trimestral", "inédita", "Puerto Nidal", "regional", "pesquera", "Beltrán Moya", "provisional", "portuaria", "ganadera", "Frente Costero", "bilateral"]
_PLACE = ["Ibara", "Alto Sauce", "Puerto Nidal", "San Corvo", "Loma Verde", "Río Tibio", "Valle Hondo", "Santa Ría"]
_FIRST = ["Lena", "Marta", "Iván", "Raúl", "Inés", "Óscar", "Teo", "Nora"]
_LAST = ["Ardila", "Osuna", "Beltrán", "Cárdenas", "Prieto", "Luengo", "Moya", "Sastre"]


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _sentence(r: random.Random, names: int = 1) -> str:
    s = f"{r.choice(_WHO)} {r.choice(_DID)} {r.choice(_WHAT)}"
    for part in (_WHEN, _AND):
        if r.random() < 0.75:
            s += " " + r.choice(part)
    for _ in range(names):  # prose rich in names and adjectives
        w = s.split(" ")
        w.insert(r.randint(2, len(w)), r.choice(_EXTRA))
        s = " ".join(w)
    if r.random() < 0.2:
        return "¿Qué pasará ahora con " + r.choice(_WHAT) + "?"
    if r.random() < 0.2:
        s = f"«{s}», se lee en la carta que {r.choice(_WHO)} envió a EE. UU."
    return s[0].upper() + s[1:] + ("" if s[-1] == "." else ".")


def _prose(r: random.Random) -> str:
    n, style, names = r.randint(1, 24), r.choice([0, 1, 2, 3, 4, 4, 4, 5, 5, 6, 6, 7]), r.randint(0, 6)
    s = [_sentence(r, names) for _ in range(n)]
    if style == 0:
        return "\n".join(s)
    if style == 1:
        s = ["—" + x if i % 2 else "—¿Y qué opina de " + r.choice(_WHAT) + "?" for i, x in enumerate(s)] + ["—" + _sentence(r)]
        return "\n".join(s)
    paras, i = [], 0
    while i < n:
        k = r.randint(1, 5)
        paras.append(" ".join(s[i : i + k]))
        if r.random() < (0.7 if style == 6 else 0.1):
            paras.append(r.choice(["La cuenta", "Lo que sigue", "Contexto", "Un día largo"]))
        i += k
    if paras[-1][-1] != "." and paras[-1][-1] != "?":
        paras.append(_sentence(r))
    t = r.choice(["\n", "\n\n"]).join(paras)
    if style == 2:
        return t.upper()
    if style == 3:
        return _plain(t)
    if style == 4:
        return "\n".join(" ".join(w) for w in _wrap("".join(c for c in t.lower() if c not in string.punctuation + "«»¿—").split(), r.randint(40, 80)))
    if style == 5 and n >= 6:
        return t + "\nEstos son los puntos:\n" + "\n".join(f"- {r.choice(_WHAT)}" for _ in range(r.randint(3, 5))) + "\n" + " ".join(_sentence(r) for _ in range(6))
    return t


def _wrap(words: list[str], k: int) -> list[list[str]]:
    return [words[i : i + k] for i in range(0, len(words), k)]


def _other(r: random.Random) -> str:
    n, kind = r.randint(8, 70), r.randrange(16)
    name = lambda: f"{r.choice(_FIRST)} {r.choice(_LAST)}" + (f" {r.choice(_LAST)}" if r.random() < 0.5 else "")
    mark = r.choice(["- ", "• ", "* ", "", "· "])
    if kind == 0:
        rows = [mark + name() + r.choice(["", f" ({r.choice(_PLACE)})", f", {r.choice(_PLACE)}"]) for _ in range(n)]
    elif kind == 1:
        form = r.choice(["{} - ", "{}. ", "{}.- ", "- "])
        rows = [form.format(i + 1) + r.choice(_WHAT) + r.choice(["", " " + r.choice(_WHEN), " " + r.choice(_AND)]) for i in range(n)]
    elif kind == 2:
        sep = r.choice([",", ";", "|", " | ", "\t", "\t|\t", " ¦ "])
        rows = [sep.join([r.choice(_PLACE), str(r.randint(100, 9999)), str(r.randint(1, 999)), r.choice(["SI", "NO", "N/D"]), f"{r.random():.3f}"]) for _ in range(n)]
    elif kind == 3:
        rows = [f"{r.choice(_PLACE):<26}{r.randint(1, 99999):>8}{r.randint(1, 99999):>9}{r.randint(1, 99):>6}" for _ in range(n)]
    elif kind == 4:
        rows = [f"{r.choice(['NIT', 'Tel', 'Acta', 'Folio', 'Cargo', 'Ref'])}: {r.randint(1000, 999999)}{r.choice(['', '-A', '/25', ' *'])}" for _ in range(n)]
    elif kind == 5:
        rows = [f"https://{r.choice(_PLACE).replace(' ', '').lower()}.example/{_plain(r.choice(_WHAT)).replace(' ', '-')}/{r.randint(1, 999999)}" for _ in range(n)]
    elif kind == 6:
        w = lambda: "".join(r.choices(string.ascii_lowercase + string.digits, k=5))
        rows = [r.choice([f"$('#{w()}').on('click', fn{r.randint(1, 999)});", f"var {w()} = {r.randint(1, 999)};", f".{w()} {{ margin: {r.randint(1, 999)}px; }}", f"if ({w()}) {{ load({r.randint(1, 999)}); }}"]) for _ in range(n)]
    elif kind == 7:
        b = base64.b64encode(r.randbytes(57 * n)).decode()
        rows = [b[i : i + 76] for i in range(0, len(b), 76)]
    elif kind == 8:
        signs = r.choice(["Ã�?", "¶¤#@%&*~^", "³¡œ±©â€"])
        rows = ["".join(r.choice("tnasrie  " + signs) for _ in range(r.randint(30, 160))) + r.choice(["", "?", "."]) for _ in range(n)]
    elif kind == 9:
        line = " ".join(r.choices(["usuarios", "docentes", "jóvenes", "hogares", "familias"], k=2)) + " " + "".join(r.choices(string.ascii_lowercase, k=6))
        rows = [line] * n
    elif kind == 10:
        rows = [f"{r.randint(6, 21)}:{r.choice(['00', '15', '30', '45'])} {r.choice(['Foro', 'Visita', 'Rueda de prensa', 'Sesión'])} – {r.choice(_PLACE)}" for _ in range(n)]
    elif kind == 11:
        rows = [f"{r.choice(_WHAT).capitalize()}: {r.randint(3, 12)} claves {r.choice(_AND)}" if r.random() < 0.5 else f"{name()} {r.choice(_DID)} {r.choice(_WHAT)}" for _ in range(n)]
    elif kind == 12:
        words = [r.choice([r.choice(_PLACE).replace(" ", "").lower(), r.choice(_LAST), r.choice(_WHAT).split()[-1], f"{r.choice(_LAST)}{r.choice(_LAST).lower()}"]) for _ in range(4 * n)]
        return r.choice([" ", " / ", " #", ", ", " | "]).join(words)
    elif kind == 13:
        w = lambda: "".join(r.choices("bcdfghjklmnpqrstvwxz", k=r.randint(3, 12))) + r.choice(["", "", "", ",", "."])
        return " ".join(w() for _ in range(3 * n))
    elif kind == 14:
        line = f"{r.choice(_WHAT)} {r.choice(['usuarios', 'jóvenes de la tierra', r.choice(_WHO)])} " + "".join(r.choices(string.ascii_lowercase + string.digits, k=6))
        return " ".join([line] * n)
    else:
        rows = [" ".join(r.choices(string.ascii_letters + string.digits, k=r.randint(20, 60))) for _ in range(n)]
    if r.random() < 0.3:
        rows.insert(0, r.choice(["Lista completa", "Estos son los datos:", _sentence(r), "Zona, Total, Mesas"]))
    if r.random() < 0.15:
        rows.append(_sentence(r))
    return r.choice(["\n", "\n", "\n\n"]).join(rows)


def labelled(n: int, seed: int = 11) -> list[tuple[str, int]]:
    """n documents, half of either label."""
    r = random.Random(seed)
    return [(_prose(r), 0) if i % 2 else (_other(r), 1) for i in range(n)]
