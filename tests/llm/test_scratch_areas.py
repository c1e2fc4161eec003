"""Scratch areas of queries that run at the same time are apart."""

import threading

from placewise.llm._shared import Scratch, scratch_area


def test_areas_of_two_threads_do_not_meet(spark):
    there, go = threading.Barrier(2), threading.Barrier(2)
    got = {}

    def work(name):
        with scratch_area(spark, name):
            there.wait(60)
            df = Scratch(spark, "t").cut(spark.range(5), "rows")
            go.wait(60)
            got[name] = (df.count(), df.inputFiles()[0])
            if name == "a":
                return
        got["after"] = len(got)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got["a"][0] == got["b"][0] == 5 and "/a-" in got["a"][1] and "/b-" in got["b"][1]
