"""Import every operator module; their queries register themselves."""

from riskspark.llm import align, decontam, hardneg, linechunks, linefreq, packing, pii, revisits, simhash, tokencount, tokenfile, toxicity, zquality  # noqa: F401
from riskspark.llm.common import ORACLES, QUERIES  # noqa: F401
