"""The font scheme is read where it gives Vietnamese syllables or letters that other languages have too."""

from collections import Counter

from papyrine.llm import encoding


def test_words_of_other_languages_are_not_read_in_the_font_scheme():
    for word in ("höchstens", "möglich", "hôtel", "goût", "août", "tôt", "maïs", "île", "España", "Israélien", "ÖPNV"):
        assert encoding.from_font(word) == word, word


def test_font_scheme_gives_syllables_initials_and_shared_letters():
    read = {"ñöôïc": "được", "Tröôøng": "Trường", "(aùp": "(áp", "QUYEÀN.": "QUYỀN.", "GÖûI": "GỬI", "ÑAùP": "ĐÁP", "ÑT:": "ĐT:", "deùtails": "détails", "theùaâtre,": "théâtre,"}
    assert {w: encoding.from_font(w) for w in read} == read


def test_a_correct_german_word_is_never_affected():
    # as in the tables: the only word that begins with hö, frequent enough to be held out but not to be known, and many words begin with hư
    vietnamese = "hướng hưởng hư hứa hương hữu hưng hưu chưa thư nhưng phương đại học được nhận trường số người nước mười lượng thưởng"
    german = "die universität nimmt studierende für das jahr auf mindestens erstens nächste nachstens wachstum"
    words = Counter({w: 2_000 for w in f"{vietnamese} {german}".split()}) + Counter({"höchstens": 18})
    words += Counter({f"{a}{b}{c}en": 100 for a in "bdghklmnrt" for b in "aeiou" for c in "bdgklmnrst"})  # a larger vocabulary
    for before in range(5):  # every place of the word among those held out
        model = encoding.learned(words + Counter({f"aa{i}": 50 for i in range(before)}), 1_500)
        assert encoding.garbled_words("Die Universität nimmt höchstens", model) == {}
        assert set(encoding.garbled_words("Sinh höôùng ñöôïc", model).values()) == {"hướng", "được"}


def test_the_model_has_the_held_out_words():
    counts = Counter({f"{a}{b}ợ": 30 for a in "bcdghklmnp" for b in "aeou"})
    assert encoding.learned(counts, 1_000).three == encoding.counted(counts).three
