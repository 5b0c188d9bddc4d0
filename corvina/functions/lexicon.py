"""Word lists."""

from __future__ import annotations

# An inline list of Spanish stop words.
INLINE_STOP_WORDS = (
    "a acá ahí al algo algún alguna algunas alguno algunos allá allí ante antes aquel aquella aquellas aquello aquellos aquí así aún bajo bastante bien "
    "cabe cada casi como con contra cual cuales cualquier cualquiera cualquieras cuán cuándo cuánto de dejar del demás demasiado donde dos el él "
    "ella ellas ellos en entre era eran eres es esa esas ese eso esos esta está están estas este esto estos estoy fue fueron fui ha han "
    "hasta hay la las le les lo los más me mi mis mucha muchas mucho muchos muy nada ni no nos nosotros nuestra nuestras nuestro "
    "nuestros o os otra otras otro otros para pero poco por porque que qué quien quién quienes se sea según ser si sí sin sobre "
    "so somos son su sus también tan tanto te tenemos tener tiene tienen toda todas todavía todo todos tu tus un una uno unos usted ustedes ya yo"
).split()

# Words that negate, and openings that exaggerate.
NEGATIONS = ("no", "nunca", "jamás", "ni")
HYPERBOLE = ("qué gran", "increíble", "qué sorpresa", "me encanta", "claro", "fascinante")

#: Spark's names of the languages of the test tables.
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}


def stop_words(lang: str = "es") -> list[str]:
    """Spark's default list of a language (Spanish: 313 words), in lower case, sorted."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(LANGUAGES.get(lang, lang))})
