"""reelquery: content-based video retrieval as ordinary Spark DataFrame plans."""

import atexit
import os
import shutil
import tempfile
import zipfile

_SENT: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="reelquery-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "reelquery.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("reelquery", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
