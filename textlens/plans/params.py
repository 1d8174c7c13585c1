"""Fixed parameters of the registered queries.

Fixed values taken from the reference configuration:
  default preparator: nGram 1, numFeatures 500, SPPMI off
  evaluation preparator: nGram 2, numFeatures 5000; k = 3 folds
  evaluation grid: Naive Bayes lambda 0.25 and 1.0; logistic regParam 0.5 and 1.25
  logistic regression: maxIter 10, threshold 0.5
  L1 learner: 250 passes, penalty 5e-8, mini-batches of 1000, rate 0.1; hashed learner: 22 bits, penalty 5e-8
  SPPMI shift k = 10
"""

LABEL_COL = "toxic"

TF_NGRAM = 1
TF_FEATURES = 500

EVAL_NGRAM = 2
EVAL_FEATURES = 5000
EVAL_K = 3
NB_LAMBDA = 0.25
NB_GRID = (0.25, 1.0)
LR_GRID = (0.5, 1.25)
LR_MAX_ITER = 10
L1_MAX_ITER = 250
L1_REG = 5e-8
L1_BATCH = 1000
L1_RATE = 0.1

SPPMI_NGRAM = 1
SPPMI_FEATURES = 500
SPPMI_K_DENSE = 1   # nearly every seen pair is positive
SPPMI_K_SPARSE = 2  # a few hundred positive pairs
SPPMI_K_EVAL = 10   # with EVAL_NGRAM and EVAL_FEATURES

# The hashed learner at its configured size, step and number of passes; its n-gram
# order 2 exercises the 1..n features (the default variant has 1).
HASHED_LR_BITS = 22
HASHED_LR_STEP = 5.0
HASHED_LR_PASSES = 1
HASHED_LR_NGRAM = 2
HASHED_LR_REG = 5e-8

STOPWORD_EVENT = "click"
STOP_SHARE = 10  # words that more than one document in so many has
SCAN_EVENTS = ("purchase", "signup")
PROP_KEY = "k"
DIGITS = 6
