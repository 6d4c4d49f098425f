"""tokenmill: corpus preparation, tokenisation, training-example building and
scoring as Spark DataFrame jobs.

Every public operator is a function ``f(df, *, params) -> DataFrame`` built on
Spark SQL expressions; Arrow-batched Python runs only inside the text codec
(NFKC, Viterbi segmentation), the unigram E-step and the generation loop.
"""

__version__ = "0.1.0"
