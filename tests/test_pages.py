import tracemalloc

import pyarrow as pa

from siltstone.sources import pages


def test_snapshots_of_a_batch_become_arrow_in_slices(monkeypatch):
    """A batch of 2,000 pages with 50 links each holds the objects of a slice only; all at once took more than 30 MB."""
    monkeypatch.setattr(pages, "SLICE", 50_000)
    html = "<title>t</title><p class='c'>" + "".join(f"<a href='/page/{i}'>anchor {i}</a>" for i in range(50)) + "</p>"
    n = 2_000
    own = [pa.array([f"https://x.org/{i}" for i in range(n - 1)] + [None]), pa.array([html] * (n - 1) + [None])]
    tracemalloc.start()
    found = pages._parsed(*own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6, peak
    assert len(found) == n and found[5].as_py() == pages._snapshot("https://x.org/5", html) and found[n - 1].as_py() == {"title": "", "text": "", "links": []}
