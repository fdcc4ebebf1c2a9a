import random

import pytest

from candleframe.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with unusual characters, white space and special strings."""
    rng = random.Random(5)
    fixed = ["", " ", "\n\n", "a", "it's 's don't 'S", "x" * 3000, "ab" * 700, "日本語テキスト 漢字", "²½ ١٢ 12a", "İıſK ΣΑΣ", "\x1c\x1d a\x85b\xa0 c  \n\n d ", "<|endoftext|> <|ENDOFTEXT|>", "é ́a"]
    pick = lambda: chr(rng.choice([rng.randrange(128), rng.randrange(0x250), rng.randrange(0x3000), 32, 10, 39]))
    return fixed + ["".join(pick() for _ in range(rng.randrange(40))) for _ in range(300)]
