"""Rows that wait for the watermark are kept in chunks and not read again when others arrive."""

from types import SimpleNamespace

from cellscape.streaming.scenes import OrderedSums


def test_arriving_rows_do_not_read_those_that_wait():
    kept, timers = [], []
    sums = OrderedSums(3.0, 0.5, None)
    sums.handle = SimpleNamespace(listTimers=lambda: iter(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    sums.waiting = SimpleNamespace(appendList=kept.extend)  # without get
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows = lambda *us: iter([SimpleNamespace(us=u, y=None if u % 2 else 1.0, mean=0.0, std=1.0) for u in us])
    for batch, due in (((9_000, 5_001), 6), ((8_000,), 6), ((2_000, 3_000), 2)):
        list(sums.handleInputRows((1,), rows(*batch), clock))
        assert timers == [due]
    list(sums.handleInputRows((1,), rows(*range(10_000, 12_500)), clock))
    assert [len(chunk[0]) for chunk in kept] == [2, 1, 2, 1000, 1000, 500] and timers == [2]
    assert kept[0] == ([9_000, 5_001], [1.0, None], [0.0, 0.0], [1.0, 1.0])
