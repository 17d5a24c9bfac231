"""Numbers that readers, operators and checks share."""

# Special tokens in the order of their ids, 0 to 22.
SPECIAL_TOKENS = (
    "<bos>", "<eos>", "<pad>", "<unk>", "<schema>", "<question>", "<sql>", "</schema>", "</question>", "</sql>",
    *(f"<reserved_{i}>" for i in range(13)),
)
BOS, EOS, PAD, UNK = 0, 1, 2, 3
SCHEMA, QUESTION, SQL, END_SCHEMA, END_QUESTION, END_SQL = 4, 5, 6, 7, 8, 9
FIRST_BYTE = len(SPECIAL_TOKENS)  # the byte tokenizer's id of byte 0

# Sizes, bounds, seed, shares and ceilings.
VOCAB_SIZE = 12_288
SEQUENCE_LENGTH = 512
FINETUNE_LENGTH = 1024
MIN_CHARS, MAX_CHARS = 100, 1_000_000
VAL_PERCENT = 1
SEED = 42
RATE_CEILING = 1e-6
PROPORTION_TOLERANCE = 0.05
