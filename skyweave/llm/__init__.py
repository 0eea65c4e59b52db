"""Training-data operators: language id, dedup, decontamination, classifiers, mixing, search, token output.

Shared conventions of the subpackage:

* a null document id takes no part in cross-document decisions; the row itself is kept or scored;
* null and empty texts are valid inputs with a defined result (see each operator);
* columns an operator does not need are ignored, or passed through where the operator returns its input;
  an input column named like an output column is replaced by the output.
"""
