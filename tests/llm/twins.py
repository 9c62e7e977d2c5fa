"""Different texts with equal sums of bytes times powers, for any power: a word of two letters and its complement."""


def twins(a, b, size=1024):
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


PAIRS = [twins("a", "b"), twins("p", "y"), twins("x", "z", 4096)]
