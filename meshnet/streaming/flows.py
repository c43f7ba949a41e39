"""Flow matrices over faces that arrive as a stream.

The batch operators are sums over faces, so they hold for a stream as they are:
labels are a static side, and the state is one row a pair of clusters, however
many faces arrive. Faces carry no event time, so nothing is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from meshnet.operators.mesh import flow_matrix


def stream_flow_matrix(faces: DataFrame, labels: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the running flow matrix of a stream of faces in the in-memory table ``name``."""
    if not faces.isStreaming:
        raise ValueError("faces is not a stream")
    running = flow_matrix(faces, labels)
    return running.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
