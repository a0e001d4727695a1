r"""The article cleaner's patterns, written once and spelled for Java (Spark) and RE2 (the SQL checks).

In a template, \s is Unicode white space with U+001C-1F, \w letters, numbers and underscore, \d decimal digits; $ and .
know only the line feed. Flags: i ignore case (Unicode), m per line, s dot takes line feeds.
"""

from __future__ import annotations

# fixed values: phrases and line forms
_READ_ALSO = "LEA TAMBIÉN|Lea también|Lea:|Le puede interesar|Le recomendamos|También le puede interesar|Puede leer:|Siga leyendo|Ver más:|Ver también:|Leer más:"
START_WORDS = "Noticia|Análisis|Opinión|Editorial|Reportaje|Crónica|Entrevista|Exclusivo suscriptores"
LISTING_HEADS = (
    r"Más para ver|Nuestro mundo|Más noticias|Lo más leído|Lo último|Más sobre|También en [A-Z]|Tendencias|En portada|Otras noticias|"
    r"Horóscopo\s*\n|Crucigrama\s*\n|BOLETINES EL TIEMPO|EL TIEMPO GOOGLE NEWS|EL TIEMPO WHATSAPP|EL TIEMPO APP|SUSCRÍBETE AL DIGITAL|"
    r"Sigue toda la información de [A-Z][^\n]{1,50} en Facebook|Conforme a los criterios de\s*\z"
)

#: (step, flags, template, replacement, once), in the order in which they apply. C13, lines of authors, comes before C14.
STEPS: tuple[tuple[str, str, str, str, bool], ...] = (
    ("C0", "s", rf"\A.*?\n\s*(?:{START_WORDS})\s*\n", "", True),
    ("C1", "s", r"En este portal utilizamos datos de navegación.*?(?:aceptando esta utilización\.?|Puede conocer cómo deshabilitarlas[^\n]*|aquí)", "", False),
    ("C2", "i", r"(?:\A|\n)\s*Puede conocer cómo deshabilitarlas u obtener más información\s*\n\s*aquí\s*\n", "\n", False),
    ("C3", "im", r"^\s*(?:aquí|Aceptar(?:\s+y\s+continuar)?|Continuar\s+sin\s+aceptar|Configuración\s+de\s+cookies|Política\s+de\s+privacidad|Términos\s+y\s+condiciones)\s*$", "", False),
    ("C4", "", r"(?:Ya tienes una cuenta vinculada a [A-Z\s]+,\s*por favor inicia sesión[^\n]*|¡Hola! Parece que has alcanzado tu límite[^\n]*|¿Quieres seguir disfrutando de este y otros beneficios[^\n]*|Adquiere el plan de suscripción[^\n]*|¡Hola! Haz? excedido el máximo de peticiones[^\n]*|Para más información continua navegando en[^\n]*)", "", False),
    ("C5", "", r"(?:Error \d{3}\s*\n[^\n]*|Estamos resolviendo el problema[^\n]*|Procesando tu pregunta[^\n]*|¿Sabías que registrándote en nuestro portal[^\n]*|Con el envío de tus consultas, aceptas los Términos[^\n]*|Recuerda que las respuestas generadas pueden presentar inexactitudes[^\n]*|De acuerdo con las políticas de la IA[^\n]*|no es posible responder a las preguntas relacionadas[^\n]*)", "", False),
    ("C6", "", rf"(?:{_READ_ALSO}|Más noticias|Noticias relacionadas|Siga el minuto a minuto:?)\s*\n\s*\n?[^\n]{{0,200}}\n?", "", False),
    ("C7", "", rf"(?:{_READ_ALSO}):?\s*", "", False),
    ("C8", "i", r"(?:Haga clic aquí para seguirnos en WhatsApp|Si desean? inscribirse|Queremos tener una comunicación más directa|Únete a nuestro canal de WhatsApp|Síguenos en WhatsApp)[^\n]*\n?", "", False),
    ("C9", "m", r"\n\s*(?:[A-ZÁÉÍÓÚÑ\s]{5,50}\s*\n\s*Periodista\s+de\s+[^\n]{1,80}\.?|Redacción\s+[^\n]{1,50}\.?)\s*$", "", False),
    ("C10", "m", r"\n\s*[\w.+-]+@[\w-]+\.[\w.]+\s*$", "", False),
    ("C11", "m", r"\n\s*(?:PORTAFOLIO|EL TIEMPO|EL ESPECTADOR|SEMANA)\s*$", "", False),
    ("C12", "s", rf"\n\s*(?:{LISTING_HEADS}).*\z", "", False),
)
#: Fixed forms, as STEPS.
AFTER_AUTHORS = (("C14", "m", r"[ \t]+$", "", False), ("C15", "", r"\n{3,}", "\n\n", False))

#: First path segments of pages without political news. Fixed values.
NOISE_SECTIONS = (
    "deportes", "deporte", "futbol", "liga", "entretenimiento", "farandula", "gente", "celebridades", "tecnologia", "tech",
    "gadgets", "videojuegos", "loterias", "horoscopo", "astrologia", "turismo", "viajes", "destinos", "recetas", "cocina",
    "gastronomia", "moda", "belleza", "estilo", "autos", "carros", "motos", "podcasts", "multimedia", "en-vivo", "videos",
    "ocio", "juegos", "salud", "bienestar", "cine", "musica", "television", "contenido-patrocinado", "branded-content",
)

_CLASSES = {
    "java": {"s": r"\s\x1c-\x1f", "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"},
    "re2": {"s": r"\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}", "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"},
}


def spell(template: str, flags: str, dialect: str) -> str:
    """A template for one dialect."""
    out, i, inside = [], 0, False
    while i < len(template):
        c = template[i]
        if c == "\\":
            k = template[i + 1]
            if k in "swd":
                body = _CLASSES[dialect][k]
                out.append(body if inside else f"[{body}]")
            else:
                out.append(c + k)
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    f = ("dU" if dialect == "java" else "") + flags.replace("i", "iu" if dialect == "java" else "i")
    return (f"(?{f})" if f else "") + "".join(out)
