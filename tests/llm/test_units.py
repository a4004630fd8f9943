"""Words are units whatever stands behind them, with the ids of a segmentation without cuts; one automaton is run after the other; what a task holds is bounded."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from runloom.llm import language, pieces, substring
from runloom.llm.vocabulary import load


def test_a_word_is_one_unit_before_any_mark():
    c = pieces.Codec(load())
    c.encode("word word, word. word; (word) word...")
    assert sum("word" in u for u in c.memo) == 2  # with a space before it and without
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choices("ab thE.,1²³9_▁ \n–ñß́中½٣,()#  e", k=draw.randrange(1, 60)))
        s = pieces.prepared(" " + text)
        assert c.encode(text) == c.ids_between(s, c.paths(s, 0, len(s)), 0, len(s)), text


def test_each_automaton_meets_all_texts_in_turn(monkeypatch):
    p = language.CrossParser({"a": " abc abd ", "b": " bcd bce ", "c": " xyz "})
    met, count = [], language.SuffixAutomaton.phrases
    monkeypatch.setattr(language.SuffixAutomaton, "phrases", lambda self, text: met.append(p.automata.index(self)) or count(self, text))
    best, score = p.of(["abc", "", "12", "bcd bce", "xyz", "q"])
    assert best.tolist() == [0, -1, -1, 1, 2, 2] and score[1] == score[2] == 0
    assert met == sorted(met)
    assert not hasattr(p.automata[0], "next")  # the dictionaries by number are gone


def test_units_that_come_often_are_made_once(monkeypatch):
    c, made = pieces.Codec(load(), 8), []
    monkeypatch.setattr(c, "ids_of", lambda u, of=c.ids_of: made.append(u) or of(u))
    for i in range(30):
        assert c.encode(f"often x{i:03d}") and len(c.memo) + len(c.memo.before) <= 8
    assert sum("often" in u for u in made) == 1


def _sent(n, words):
    """n batches of documents of their own, as Spark sends them: the columns of a batch are parts of one buffer."""
    sink = pa.BufferOutputStream()
    draw = random.Random(7)
    rows = [pa.record_batch({"id": pa.array([i]), "mark": pa.array([i * 77]), "text": pa.array([" ".join(f"w{draw.randrange(1 << 30)}" for _ in range(words))])}) for i in range(n)]
    with pa.ipc.new_stream(sink, rows[0].schema) as w:
        for r in rows:
            w.write_batch(r)
    return pa.ipc.open_stream(sink.getvalue().to_pybytes())


def test_suspects_let_go_of_the_texts():
    """Of the texts whose windows a block gathers only numbers stay."""
    held = []

    def read():
        for b in _sent(20, 5_000):
            copy = pa.ipc.read_record_batch(b.serialize(), b.schema)
            held.append(pa.total_allocated_bytes())
            yield copy

    step = substring._suspects(SimpleNamespace(value=np.full((1 << 16) // 8, 255, np.uint8)), 16, 64, 20)
    out = [x for b in step(read()) for x in b.column("docs").to_pylist()]
    assert out
    assert held[-1] - held[1] < 300_000, held  # a text has some 55,000 bytes


def test_sketch_has_one_block(monkeypatch):
    """Each task counts in one block of words, which is neither joined from parts nor copied whole."""
    monkeypatch.setattr(substring, "BLOCK", 1 << 20)
    batches = list(_sent(30, 100_000).read_all().select(["text"]).to_batches())
    tracemalloc.start()
    rows = [sum(len(x) for x in b.column("cells").to_pylist()) for b in substring._sketch(40, 512, 20)(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 3
    assert peak < 60 << 20
