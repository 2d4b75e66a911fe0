"""What Python workers keep between tasks."""

from subscope.llm.common import per_worker, sliced


def test_a_kept_object_goes_with_the_first_task_that_does_not_ask_for_it():
    made = []

    def task(asks):
        found = per_worker("test object", lambda: made.append(1) or object()) if asks else None
        assert list(sliced(iter([]))) == []
        return found

    first = task(True)
    assert task(True) is first and len(made) == 1
    task(False)  # another stage's task
    assert task(True) is not first and len(made) == 2
    task(False)
