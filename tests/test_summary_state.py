"""A bucket of products is one value of the state: read and written once a batch, whatever it holds."""

from types import SimpleNamespace

import pandas as pd

from shelfspark.streaming import jobs

DAY = 86_400_000


def test_a_bucket_is_read_and_written_once_a_batch():
    calls, held = [], {}
    state = SimpleNamespace(get=lambda: calls.append("get") or held.get("v"), update=lambda v: calls.append("update") or held.update(v=v), clear=lambda: calls.append("clear") or held.clear())
    handle = SimpleNamespace(getValueState=lambda *a: state, registerTimer=lambda t: calls.append(("set", t)), deleteTimer=lambda t: calls.append(("unset", t)))
    p = jobs._NewestOffer(60 * DAY)
    p.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    frame = lambda days, epoch, price: pd.DataFrame({"product_id": range(500), "epoch": epoch, "offer_id": 1, "price": price, "observed_at": [pd.Timestamp((days + i % 5) * DAY, unit="ms") for i in range(500)]})
    took = lambda rows: [f for f in rows]
    first = took(p.handleInputRows((7,), iter([frame(100, 1, 10), frame(99, 1, 20)]), at(100 * DAY)))
    assert calls == ["get", ("set", 160 * DAY), "update"] and len(first) == 1 and len(first[0]) == 500
    assert set(first[0]["lowest_price"]) == {10} and set(first[0]["status"]) == {"complete"}
    calls.clear()
    assert took(p.handleInputRows((7,), iter([frame(90, 1, 5)]), at(100 * DAY))) == [] and calls == ["get"]  # older ones change nothing
    over = took(p.handleExpiredTimer((7,), at(161 * DAY), SimpleNamespace(getExpiryTimeInMs=lambda: 160 * DAY)))[0]
    assert sorted(over["product_id"]) == [i for i in range(500) if i % 5 < 2] and set(over["status"]) == {"pending"} and over["lowest_price"].isna().all()
    calls.clear()
    late = took(p.handleInputRows((7,), iter([frame(50, 2, 7).head(2), frame(120, 2, 8).tail(1)]), at(161 * DAY)))[0]
    assert list(zip(late["product_id"], late["status"])) == [(0, "pending"), (1, "pending"), (499, "complete")] and calls.count("update") == 1
