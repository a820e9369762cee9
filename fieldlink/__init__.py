"""fieldlink: hub-and-spoke asset distribution as Spark batch and streaming jobs.

Stages are plain ``DataFrame -> DataFrame`` functions (``fieldlink.operators``)
so the same code runs on a batch read of a topic log and on a ``readStream``
of it. Storage access lives in ``fieldlink.sources``; scalar expressions in
``fieldlink.functions``; registered queries and their stand-in inputs in
``fieldlink.plans``; streaming wiring in ``fieldlink.streaming``.
"""

__version__ = "0.1.0"
