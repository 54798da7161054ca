"""Bit-serial codecs in Python and numpy: one call for each image, exposed to Spark as Arrow functions in ``sources``."""
