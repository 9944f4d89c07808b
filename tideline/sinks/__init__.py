"""Writers: lake layers, published table, warehouse."""
