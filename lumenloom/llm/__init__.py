"""Large-scale training-data operators (dedup, decontamination, classifiers, packing)."""
