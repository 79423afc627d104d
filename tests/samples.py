"""Values that several tests plant."""


def token(n: int) -> str:
    """n characters, letter and digit in turn."""
    return ("a1b2c3d4e5f6g7h8i9j0" * (n // 20 + 1))[:n]
