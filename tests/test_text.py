from pyspark.sql import functions as F

from corvina.functions import lexicon
from corvina.functions import text as tx
from corvina.functions.stemmer import stem


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_cleaning(spark):
    assert one(spark, "<b>Hola</b>,  Mundo_1!\n", tx.clean_text) == "hola mundo_1"
    assert one(spark, None, tx.clean_text) == ""
    assert one(spark, " Mira @ana https://x.y/z #tag ¡QUÉ 3! www.a.b ", tx.normalize_comment) == "mira qué 3"
    row = spark.createDataFrame([("", "a b")], "t string, s string").select(tx.clean_item(F.col("t"), F.col("s")).alias("y")).first()
    assert row["y"] == " a b"


def test_tokens(spark):
    assert one(spark, "Evacuación, a señalética.", tx.vector_tokens) == ["evacuación", "señalética"]
    assert one(spark, "a, b!! c", tx.word_tokens) == ["a", ",", "b", "!", "!", "c"]
    assert one(spark, "a, b!! c", tx.wordpunct_tokens) == ["a", ",", "b", "!!", "c"]
    assert one(spark, "El nodo: norte.", lambda c: tx.split_words(tx.index_analysis(c))) == ["el", "nodo", "norte"]
    assert one(spark, "a b c", lambda c: tx.ngrams(tx.split_words(c), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: tx.ngrams(tx.split_words(c), 2)) == []
    assert one(spark, "uno 22 x3", lambda c: tx.alphabetic(tx.split_words(c))) == ["uno"]


def test_small_functions(spark):
    assert one(spark, "fútbol", tx.fold_accents) == "futbol"
    assert one(spark, "/a/b/c.tar.gz", tx.basename) == "c.tar.gz"
    assert one(spark, "/a/b/c.tar.gz", tx.stem_of_path) == "c.tar"
    assert one(spark, "/a/b/c.gz", tx.parent) == "b"
    assert one(spark, "01001000", tx.bits_to_character) == "H"
    assert one(spark, "hola###FIN###x", tx.up_to_terminator) == "hola###FIN###"
    assert one(spark, "hola", tx.up_to_terminator) == "hola"
    assert one(spark, "Qué gran día", tx.starts_hyperbolic) is True
    assert one(spark, "no me gusta", tx.has_negation) is True
    assert one(spark, "nota", tx.has_negation) is False


def test_word_lists(spark):
    assert len(lexicon.INLINE_STOP_WORDS) == 153
    assert len(lexicon.stop_words("es")) == 313


def test_stems():
    # published examples of the algorithm
    for word, want in {"chicos": "chic", "torneos": "torne", "toreándolo": "tor", "comunicación": "comun", "rápidamente": "rapid", "averigüéis": "averigü", "haciéndola": "hac", "clases": "clas"}.items():
        assert stem(word) == want, word
