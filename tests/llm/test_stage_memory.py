"""What a stage of the pipeline leaves in the driver."""

import gc
import weakref

from strandlake.llm import common


class Model:
    """Stands for what a stage's functions hold, in a ring as data frames and their functions are."""

    def __init__(self):
        self.own = self


def test_a_new_stage_frees_what_the_last_one_held(spark):
    gc.disable()
    try:
        left = weakref.ref(Model())
        assert left() is not None
        common.new_stage(spark)
        assert left() is None
    finally:
        gc.enable()
