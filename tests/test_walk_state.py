"""A walker's steps of a batch cost two requests to the state store, not one each."""

import pandas as pd

from corpusloom.streaming import steps


class Kept:
    def __init__(self):
        self.rows, self.asked = [], 0

    def get(self):
        self.asked += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self.asked += 1
        self.rows += rows


def test_requests_do_not_grow_with_the_steps():
    state = Kept()
    handle = type("Handle", (), {"getListState": lambda self, name, schema: state})()
    walks = steps._Walks()
    walks.init(handle)
    batch = lambda seqs: iter([pd.DataFrame({"seq": seqs, "node": [f"n{k}" for k in seqs]})])
    first = pd.concat(walks.handleInputRows((7,), batch([*range(0, 2000, 2)]), None))
    assert state.asked == 2 and len(first) == 1000 and set(first["version"]) == {1}
    late = pd.concat(walks.handleInputRows((7,), batch([3, 3, 4]), None))
    assert state.asked == 4 and late.values.tolist() == [[7, 3, "n2", "n3", 2], [7, 4, "n3", "n4", 2]]
    assert not list(walks.handleInputRows((7,), batch([3]), None)) and len(state.rows) == 1001
