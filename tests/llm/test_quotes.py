import pytest

from palisade.llm import toxicity


@pytest.mark.parametrize("text,quoted", [
    ("you’re an idiot and i don’t care, you idiot", 0),
    ("l’homme est un idiot, c’est l’idiot d’ici", 0),
    ("you‘re an idiot and i don‘t care", 0),
    ('"good day" he is an idiot and "so on"', 0),
    ("“good day” he is an idiot and “so on”", 0),
    ("“never closed, an idiot", 0),
    ('an inch is 1" and\nan idiot is 2" long', 0),
    ("he said ‘what an idiot’ and left", 1),
    ("he said ‘don’t be an idiot’ and left", 1),
    ("„so ein idiot“ und «quel idiot» und »der idiot«", 3),
    ("“" + "word " * 40 + "idiot " + "word " * 40 + "”", 1),
])
def test_marks_are_paired(text, quoted):
    score, n, _, got = toxicity.Scorer({"idiot$": 0.95}, 0.02).score(text)
    assert got == quoted
    assert (score >= 0.5) == (n > quoted)
