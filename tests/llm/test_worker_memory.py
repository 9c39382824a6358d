"""What a Python worker holds on to between the steps it serves."""

import numpy as np
import pyarrow as pa

from proxyspark.llm import common, langid


def test_a_large_value_goes_when_another_is_asked_for(monkeypatch):
    monkeypatch.setattr(common, "worker_store", lambda store={}: store)
    made = []
    big = lambda: made.append("big") or object()
    first = common.kept("big", big, large=True)
    assert common.kept("big", big, large=True) is first and made == ["big"]
    small = common.kept("small", object)
    assert "big" not in common.worker_store()
    assert common.kept("big", big, large=True) is not first and common.kept("small", object) is small


def test_a_task_gives_back_what_it_freed(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(True))
    batch = pa.record_batch([pa.array(["a", "b"])], names=["text"])
    run = common.lean(lambda batches: (b for b in batches))
    assert list(run([batch, batch])) == [batch, batch] and done == [True]
    some = run([batch, batch])
    next(some)
    some.close()  # a limit ends a task early
    assert done == [True, True]


def test_freed_memory_is_returned_to_the_system():
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    before = resident()
    held = [np.ones(4_000) for _ in range(4_000)]  # 128 MB in pieces that malloc keeps
    last = np.ones(4_000)  # and one behind them
    held.clear()
    common.give_back()
    assert resident() - before < 40e6 and len(last)


def test_language_lets_go_of_a_tokenizer(spark, docs_of, monkeypatch):
    monkeypatch.setattr(common, "worker_store", lambda store={}: store)
    common.kept(("encoder", "file"), lambda: object(), large=True)
    assert len(langid.grams_of(["some words"])[0]) and ("encoder", "file") not in common.worker_store()
