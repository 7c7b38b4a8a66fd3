"""Stopword lists.

Spark ships stopword lists for its ``StopWordsRemover`` inside the MLlib jar
(``org/apache/spark/ml/feature/stopwords/<language>.txt``). They are read from
there, so the Spark side and the SQL oracle use exactly the same rows and no
list is copied into this repository.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

_RESOURCE = "org/apache/spark/ml/feature/stopwords/{}.txt"


@functools.lru_cache(maxsize=None)
def _mllib_jar() -> str:
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for pattern in ("jars/spark-mllib_*.jar", "jars/spark-mllib*.jar"):
        found = sorted(glob.glob(os.path.join(home, pattern)))
        if found:
            return found[-1]
    found = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__),
                                          "jars", "spark-mllib*.jar")))
    if not found:
        raise FileNotFoundError("spark-mllib jar not found")
    return found[-1]


@functools.lru_cache(maxsize=None)
def stopwords(language: str) -> tuple[str, ...]:
    """The stopword list Spark ships for ``language`` (e.g. ``english``)."""
    with zipfile.ZipFile(_mllib_jar()) as z:
        text = z.read(_RESOURCE.format(language)).decode("utf-8")
    seen = []
    for w in text.split():
        w = w.strip()
        if w and w not in seen:
            seen.append(w)
    return tuple(seen)
